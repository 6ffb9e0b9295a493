"""Writers and ``export``.  Each writes a directory of part files in parallel."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_phone
from ..functions.types import ROW_ID, is_text_type, qcol, settles

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS"


@settles
def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Header row, ``""`` escaping, ISO timestamps; leading/trailing spaces
    are kept (Spark's CSV writer trims them unless told not to)."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("timestampFormat", ISO_MILLIS).csv(path))


@settles
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_delimited(df, path, ",", mode)


@settles
def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_delimited(df, path, "\t", mode)


@settles
def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (D8: re-readable by our own loader); NULL fields kept, ISO ms timestamps."""
    (df.write.mode(mode).option("ignoreNullFields", False).option("timestampFormat", ISO_MILLIS)
     .json(path))


@settles
def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


@settles
def format_phone_columns(df: DataFrame) -> DataFrame:
    """Format phone numbers in text columns whose name contains ``phone``."""
    targets = [f.name for f in df.schema.fields
               if "phone" in f.name.lower() and is_text_type(f.dataType)]
    return df.withColumns({c: format_phone(qcol(c)) for c in targets}) if targets else df


WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet}


@settles
def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Format phone columns, drop the row label, write; returns the normalised path."""
    fmt = fmt.lower()
    if fmt not in WRITERS:
        raise ValueError(f"export: fmt={fmt!r} is not one of {sorted(WRITERS)}")
    if not path.endswith(f".{fmt}"):
        path = f"{os.path.splitext(path)[0]}.{fmt}"
    out = format_phone_columns(df)
    if ROW_ID in out.columns:
        out = out.drop(ROW_ID)
    WRITERS[fmt](out, path, mode=mode)
    return path
