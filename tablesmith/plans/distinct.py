"""Distinct counts of many columns in one pass and one shuffle.

Cells (column, 64-bit key, second hash; see ``plans.cells``) are grouped by column and
key with partial aggregation, which keeps the least and greatest second hash.  Where these
differ, different values met under one key: only such keys are resolved, by
grouping the values themselves.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import qcol
from ..session import scratch_tables, stored_table
from . import cells


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """DataFrame (column STRING, unique_count BIGINT) with a row for each column, NULLs not counted."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        return row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"d{i}").cast("bigint").alias("unique_count"))
            for i, c in enumerate(cols)])).alias("s")).select("s.*")
    with scratch_tables(df.sparkSession):
        found = cells.unpivoted(df, [dict(zip("ab", cells.keys(df, c))) for c in cols]).where("a IS NOT NULL")
        grouped = found.groupBy("slot", "a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        counts = count_keys(df, cols, grouped)
    return df.sparkSession.createDataFrame([(c, counts.get(i, 0)) for i, c in enumerate(cols)],
                                           "column string, unique_count bigint")


def count_keys(df: DataFrame, cols: list[str], grouped: DataFrame) -> dict[int, int]:
    """Distinct values by slot from ``grouped`` (slot, a, lo, hi): one small row a slot reaches the driver."""
    rows = grouped.groupBy("slot").agg(F.count("*").alias("keys"), F.count_if(F.expr("lo <> hi")).alias("met")).collect()
    counts = {r["slot"]: r["keys"] for r in rows}
    if any(r["met"] for r in rows):
        met = stored_table(grouped.where("lo <> hi").select("slot", "a"), "met-keys")
        for r in rows:
            if r["met"]:
                counts[r["slot"]] += _values(df, cols[r["slot"]], met.where(F.col("slot") == r["slot"])) - r["met"]
    return counts


def _values(df: DataFrame, col: str, met: DataFrame) -> int:
    """Distinct values of a column among the keys ``met`` (a)."""
    own = df.select(cells.keys(df, col)[0].alias("a"), cells.comparable(df, col).alias("v"))
    return own.join(met.select("a"), "a", "left_semi").groupBy("v").agg(F.lit(1)).count()


def repeated_rows(df: DataFrame, cols: list[str], grouped: DataFrame) -> int:
    """Rows that repeat an earlier row on ``cols`` from ``grouped`` (a, lo, hi, n) of row_key()."""
    row = grouped.agg(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n") - 1)).alias("sure"),
                      F.count_if(F.expr("lo <> hi")).alias("met")).first()
    total = row["sure"] or 0
    if row["met"]:
        met = stored_table(grouped.where("lo <> hi").select("a"), "met-keys")
        own = df.select(row_key(df, cols)[0].alias("__a"), *[cells.comparable(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
        exact = own.join(met.withColumnRenamed("a", "__a"), "__a", "left_semi").groupBy(
            *[f"c{i}" for i, _ in enumerate(cols)]).agg(F.count("*").alias("n"))
        total += exact.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    return total


def row_key(df: DataFrame, cols: list[str]):
    """The (a, b) of whole rows; NULL equals NULL, but is no value."""
    values = [cells.comparable(df, c) for c in cols]
    gaps = functools.reduce(lambda x, y: F.concat(x, y), [F.when(v.isNull(), "1").otherwise("0") for v in values])
    return F.xxhash64(*values), F.xxhash64(gaps, *reversed(values))
