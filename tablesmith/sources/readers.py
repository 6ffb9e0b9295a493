"""Readers: CSV, TSV, plain delimited text, JSON lines, Parquet, and ``load``.

Delimited text follows the reference's loader: a header row, the usual
missing-value tokens become NULL, and each column gets the narrowest type
all of its values fit (integer, then float, then boolean, else text; date
text stays text).  Spark's own ``inferSchema`` differs (it types ``NA``
columns as text and dates as dates), so we read strings, NULL the tokens,
infer with ONE distributed aggregate (``try_cast`` success per column), and
cast.  Nothing is collected except one row of flags.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import ROW_ID, mark_nan, qcol
from ..operators.rowid import with_row_id
from . import quoted

# ---------------------------------------------------------------------------
# Text read as missing in delimited files (pandas defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
# Boolean spellings recognised when inferring a column as boolean.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
# Text read as a number; the JVM's casts also take type suffixes ("12D"), which are text.
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
# File suffixes the loader accepts.
SUPPORTED_SUFFIXES = (".csv", ".tsv", ".txt", ".json", ".jsonl", ".parquet")
# ---------------------------------------------------------------------------


def _infer_and_cast(df: DataFrame, keep=()) -> DataFrame:
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return df
    nulled = df.select(*[F.when(~qcol(c).isin(NA_TOKENS), qcol(c)).alias(c) for c in cols], *map(qcol, keep))
    bool_tokens = TRUE_TOKENS + FALSE_TOKENS
    checks = []
    for i, c in enumerate(cols):
        v = qcol(c)
        present = v.isNotNull()
        checks += [
            F.count_if(present & (~v.rlike(INTEGER_PATTERN) | v.try_cast("bigint").isNull())).alias(f"notint{i}"),
            F.count_if(present & ~v.rlike(NUMBER_PATTERN)).alias(f"notdbl{i}"),
            F.count_if(present & ~v.isin(bool_tokens)).alias(f"notbool{i}"),
            F.count_if(present).alias(f"n{i}"),
        ]
    flags = nulled.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        v = qcol(c)
        if flags[f"n{i}"] == 0:
            out.append(v.cast("double").alias(c))          # all missing: float NaN column in pandas
        elif flags[f"notint{i}"] == 0:
            out.append(v.try_cast("bigint").alias(c))
        elif flags[f"notdbl{i}"] == 0:
            out.append(v.try_cast("double").alias(c))
        elif flags[f"notbool{i}"] == 0:
            out.append(v.isin(TRUE_TOKENS).alias(c))
        else:
            out.append(v.alias(c))
    # NaN text is an NA token, so no NaN can come out of the casts.
    return nulled.select(*out, *map(qcol, keep))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None,
                   infer: bool = True, schema=None, row_ids: bool = False) -> DataFrame:
    """Header + RFC-4180 quoting (``""`` inside quotes).

    Files are split at line ends.  One look at the text (a row per split) tells whether quoted fields hold
    line ends; if so, records are put together across lines and splits by quote parity (see
    ``sources.quoted``), which moves the text once.  ``multiline=False`` says there are none and saves the look;
    ``True`` says there are.  With a ``schema`` the text is parsed once, without the inference pass.
    ``row_ids`` adds row labels in the order of the records."""
    text = quoted.lines(spark, path)
    facts = [] if multiline is False else quoted.split_facts(text)
    if any(r["n_odd"] for r in facts):
        return _read_records(spark, text, facts, sep, infer, schema, row_ids)
    reader = (spark.read.option("header", True).option("sep", sep).option("quote", '"')
              .option("escape", '"').option("inferSchema", False).option("mode", "PERMISSIVE"))
    if schema is not None:
        df = mark_nan(reader.schema(schema).csv(path))
    else:
        raw = reader.csv(path)
        df = _infer_and_cast(raw) if infer else raw
    return with_row_id(df) if row_ids else df


def _read_records(spark: SparkSession, text: DataFrame, facts: list, sep: str, infer: bool, schema, row_ids: bool):
    """As read_delimited(), of a text whose quoted fields hold line ends."""
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    rows = quoted.records(text, facts)
    first = rows.where("top").select("value").first()["value"]  # every file starts with the header record
    rows = rows.where(~F.col("top") & (F.length(F.trim("value")) > 0))
    plain = spark.range(1).select(F.from_csv(F.lit(first), F.lit(_text_schema(first.count(sep) + 1)), options).alias("r"))
    header = [v for v in plain.first()["r"] if v is not None]
    names = header if schema is None else T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
    wanted = _text_schema(len(names)) if schema is None else (schema if isinstance(schema, str) else schema.simpleString()[7:-1])
    parsed = rows.select(F.from_csv("value", F.lit(wanted), options).alias("r"), "at")
    fields = [f.name for f in parsed.schema["r"].dataType.fields]
    df = parsed.select(*[F.col("r").getField(f).alias(n) for f, n in zip(fields, names)], F.col("at").alias(ROW_ID))
    if schema is not None:
        df = mark_nan(df)
    elif infer:
        df = _infer_and_cast(df, keep=[ROW_ID])
    return df if row_ids else df.drop(ROW_ID)


def _text_schema(n: int) -> str:
    return ", ".join(f"c{i} STRING" for i in range(n))


def read_csv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_delimited(spark, path, ",", **kw)


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_delimited(spark, path, "\t", **kw)


def read_txt(spark: SparkSession, path: str, sep: str = ",", **kw) -> DataFrame:
    return read_delimited(spark, path, sep, **kw)


def read_json_lines(spark: SparkSession, path: str, nan_as_null: bool = True) -> DataFrame:
    """One JSON object per line; Spark's types are kept (``"1"`` stays text, D9)."""
    df = spark.read.option("mode", "PERMISSIVE").json(path)
    return mark_nan(df) if nan_as_null else df


def read_parquet(spark: SparkSession, path: str, nan_as_null: bool = True) -> DataFrame:
    """Parquet as is.  ``nan_as_null`` (D1) marks the float columns: every operator takes
    their NaN for missing, while filters on them still reach the scan.  Before Spark
    expressions of your own that must see NULL, call ``functions.types.settled``."""
    df = spark.read.parquet(path)
    return mark_nan(df) if nan_as_null else df


def _suffix(path: str) -> str:
    base = path.rstrip("/").split("/")[-1]
    return os.path.splitext(base)[1].lower()


def _listed_suffix(spark: SparkSession, path: str) -> str:
    """The one data suffix of the files in a folder (names starting with _ or . are not data)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = fs.globStatus(where)
    if listed is None or not len(listed):
        raise ValueError(f"nothing to read at {path!r}")
    found = set()
    for status in listed:
        for item in fs.listStatus(status.getPath()):
            name = item.getPath().getName()
            if not name.startswith(("_", ".")) and not item.isDirectory():
                found.add(_suffix(re.sub(r"\.(gz|bz2|zst|snappy|lz4)$", "", name)))
    if len(found) != 1:
        raise ValueError(f"{path!r} holds files of {sorted(found) or 'no'} formats: pass fmt=")
    return found.pop()


def load(spark: SparkSession, path: str, fmt: str | None = None, row_id_key: str | None = None,
         partitions: int | None = None, **kw) -> DataFrame:
    """Dispatch on format or lower-cased file suffix (of a folder: its files'); adds ``_row_id``.

    A file with one row group is read by one task; ``partitions`` deals the labelled rows out to
    that many tasks, for heavy work per row.  Their order is then only in ``_row_id``."""
    df = _loaded(spark, path, fmt, row_id_key, **kw)
    return df.repartition(partitions) if partitions else df


def _loaded(spark: SparkSession, path: str, fmt: str | None, row_id_key: str | None, **kw) -> DataFrame:
    kind = (fmt or _suffix(path) or _listed_suffix(spark, path)).lower().lstrip(".")
    readers = {"csv": read_csv, "tsv": read_tsv, "txt": read_txt, "json": read_json_lines,
               "jsonl": read_json_lines, "parquet": read_parquet}
    if kind not in readers:
        raise ValueError(f"cannot tell how to read {path!r}: format {kind!r} is not one of {sorted(readers)}")
    if kind == "parquet":
        # label the raw scan: its hidden file metadata gives a deterministic row position
        nan_as_null = kw.pop("nan_as_null", True)
        df = with_row_id(spark.read.parquet(path), key=row_id_key, parquet_scan=True)
        return mark_nan(df) if nan_as_null else df
    if kind in ("csv", "tsv", "txt") and row_id_key is None:
        return readers[kind](spark, path, row_ids=True, **kw)
    return with_row_id(readers[kind](spark, path, **kw), key=row_id_key)


def is_supported(path: str) -> bool:
    return _suffix(path) in SUPPORTED_SUFFIXES


def load_info(df: DataFrame) -> DataFrame:
    """One row: rows and columns of the loaded table (row label excluded)."""
    n_cols = len([c for c in df.columns if c != "_row_id"])
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                  F.lit(n_cols).cast("bigint").alias("columns"))
