"""Row identity.

The reference keeps a pandas index label per row; order-dependent operators
(forward fill, keep-first dedup, first/last aggregates, paging) need it.  We
carry it as an explicit ``_row_id`` BIGINT column.

* With a key column (``key=``) the label is that key: deterministic, no job.
* On a Parquet scan, the label is the row's position in its file
  (``_metadata.row_index``) with the file's ordinal in the sorted file
  listing in the high bits: deterministic, and - unlike a nondeterministic
  expression - it lets Catalyst keep pushing later filters into the scan.
* Otherwise (CSV, JSON, derived DataFrames) ``monotonically_increasing_id()``
  labels rows in split order; it needs no shuffle and no single-task window.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import ROW_ID, qcol


ROW_BITS = 40                 # up to 2**40 rows per file, 2**23 files
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+"


def _norm_path(p: str) -> str:
    return "/" + re.sub(_SCHEME, "", p).lstrip("/")


def _parquet_row_id(df: DataFrame):
    """Deterministic label from the file metadata of a raw Parquet scan.

    The files' ordinals come from a join against the listing (one row per file);
    Spark picks a broadcast only if the listing's size allows it."""
    files = sorted({_norm_path(p) for p in df.inputFiles()})
    pos = F.col("_metadata.row_index").cast("bigint")
    if len(files) == 1:
        return df.withColumn(ROW_ID, pos)
    path = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "/")
    listing = df.sparkSession.createDataFrame(list(enumerate(files)), "__ord bigint, __path string")
    joined = df.withColumn("__p", path).join(listing, F.col("__p") == F.col("__path"), "inner")
    return joined.withColumn(ROW_ID, F.shiftleft(F.col("__ord"), ROW_BITS) + pos).drop("__p", "__path", "__ord")


def with_row_id(df: DataFrame, key: str | None = None, parquet_scan: bool = False) -> DataFrame:
    """Add ``_row_id``.  ``parquet_scan=True`` says ``df`` is a raw
    ``spark.read.parquet`` result, whose hidden file metadata gives the label."""
    if ROW_ID in df.columns:
        return df
    if key is not None:
        return df.withColumn(ROW_ID, qcol(key).cast("bigint"))
    if parquet_scan:
        return _parquet_row_id(df)
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def drop_row_id(df: DataFrame) -> DataFrame:
    return df.drop(ROW_ID) if ROW_ID in df.columns else df


def order_columns(df: DataFrame, order_by) -> list[str]:
    """Normalise an ``order_by`` argument to a list of column names."""
    if order_by is None:
        if ROW_ID not in df.columns:
            raise ValueError("no row order: pass order_by or call with_row_id first")
        return [ROW_ID]
    if isinstance(order_by, str):
        return [order_by]
    return list(order_by)
