"""Exact duplicate-row counts without shuffling whole rows.

Counting duplicates by grouping on every column shuffles every row in full
(for a text table: every document).  Instead:

1. Group by a 64-bit hash of the row (``xxhash64`` over all columns): the
   shuffle carries 8 bytes per row plus a count, and partial aggregation
   collapses repeated rows map-side.
2. Only rows whose hash occurs more than once can be duplicates.  They are
   selected with a semi-join on the hash (stored, so Spark knows whether it
   is small enough to broadcast) and grouped exactly on all columns.
   Distinct rows that merely share a hash are separated here, so the count
   is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import qcol
from ..session import stored_table

HASH = "__rowhash"


def _hashable(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, T.MapType) or "map<" in dt.simpleString():
        return F.to_json(qcol(c))
    return qcol(c)


def duplicate_rows(df: DataFrame, cols: list[str]) -> int:
    """Number of rows that repeat an earlier row on ``cols`` (NULL equals NULL), by the plan above."""
    if not cols:
        return 0
    keyed, cand = candidate_hashes(df.select(*[_hashable(df, c).alias(c) for c in cols]), cols)
    rows = keyed.join(cand, HASH, "left_semi")
    exact = rows.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    return exact.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]


def candidate_hashes(df: DataFrame, cols: list[str]):
    """(keyed DataFrame with HASH column, stored table of the hashes that repeat)."""
    keyed = df.withColumn(HASH, F.xxhash64(*[_hashable(df, c) for c in cols]))
    cand = keyed.groupBy(HASH).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(HASH)
    return keyed, stored_table(cand, "repeated-hashes")
