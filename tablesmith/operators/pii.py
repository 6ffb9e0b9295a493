"""PII detection over text columns.

``pii_scan`` is one job for all columns and all eight types: a single
aggregate of ``count_if(rlike)`` per (column, type), unpivoted and filtered
by the 5 % threshold.  ``pii_sample`` scans only the first N non-missing
values of each column (the profile's behaviour): one top-k per column, all
in one job, each keeping at most N rows per partition.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import (HIGH_RISK_TYPES, PII_REC_ANONYMIZE, PII_REC_COMPLIANCE, PII_REC_DETECTED,
                             PII_REC_HIGH_RISK, PII_SAMPLE_SIZE, PII_THRESHOLD_PCT, PII_TYPES, pii_match)
from ..functions.types import ROW_ID, qcol, settles, text_columns


def _type_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (column, pii_type, match_count, total) from one aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.count(qcol(c)).alias(f"t{i}"))
        for j, t in enumerate(PII_TYPES):
            aggs.append(F.count_if(pii_match(qcol(c), t)).alias(f"m{i}_{j}"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("pii_type"),
                 F.col(f"m{i}_{j}").cast("bigint").alias("match_count"),
                 F.col(f"t{i}").cast("bigint").alias("total"))
        for i, c in enumerate(cols) for j, t in enumerate(PII_TYPES)])).alias("s")).select("s.*")


def _detected(counts: DataFrame, threshold: float) -> DataFrame:
    conf = F.col("match_count") * 100.0 / F.col("total")
    return (counts.where((F.col("match_count") > 0) & (conf > threshold))
            .select("column", "pii_type", "match_count", F.round(conf, 2).alias("confidence")))


@settles
def pii_scan(df: DataFrame, cols=None, threshold: float = PII_THRESHOLD_PCT) -> DataFrame:
    """Detected (column, pii_type, match_count, confidence %) over all rows."""
    cols = text_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, pii_type string, match_count bigint, confidence double")
    return _detected(_type_counts(df, cols), threshold)


@settles
def pii_sample(df: DataFrame, cols=None, n: int = PII_SAMPLE_SIZE, order_by: str = ROW_ID,
               threshold: float = PII_THRESHOLD_PCT) -> DataFrame:
    """As ``pii_scan`` but over the first ``n`` non-missing values of each column."""
    cols = text_columns(df, cols)
    if not cols:
        return pii_scan(df, cols, threshold)
    parts = [df.where(qcol(c).isNotNull()).orderBy(qcol(order_by)).limit(n)
             .select(F.lit(c).alias("column"), qcol(c).alias("value")) for c in cols]
    sample = functools.reduce(DataFrame.unionByName, parts)
    counts = sample.groupBy("column").agg(
        F.count("value").cast("bigint").alias("total"),
        *[F.count_if(pii_match(F.col("value"), t)).cast("bigint").alias(t) for t in PII_TYPES])
    long = counts.select("column", "total", F.explode(F.array(*[
        F.struct(F.lit(t).alias("pii_type"), F.col(t).alias("match_count")) for t in PII_TYPES
    ])).alias("s")).select("column", "s.pii_type", "s.match_count", "total")
    return _detected(long, threshold)


@settles
def pii_summary(df: DataFrame, cols=None, threshold: float = PII_THRESHOLD_PCT) -> DataFrame:
    """Per column with PII: types, overall confidence (mean of kept types), high-risk flag."""
    found = pii_scan(df, cols, threshold)
    return (found.groupBy("column").agg(
        F.sort_array(F.collect_list("pii_type")).alias("pii_types"),
        F.round(F.avg("confidence"), 2).alias("confidence"),
        F.max(F.col("pii_type").isin(list(HIGH_RISK_TYPES))).alias("high_risk"))
        .orderBy("column"))


def pii_recommendations(summary: DataFrame) -> DataFrame:
    """One row: the recommendation list for a ``pii_summary`` result."""
    agg = summary.agg(F.count(F.lit(1)).alias("n"),
                      F.sort_array(F.collect_list(F.when(F.col("high_risk"), F.col("column")))).alias("hr"))
    recs = F.array_compact(F.array(
        F.when(F.col("n") > 0, F.lit(PII_REC_DETECTED)),
        F.when(F.size("hr") > 0, F.concat(F.lit(PII_REC_HIGH_RISK), F.array_join("hr", ", "))),
        F.when(F.size("hr") > 0, F.lit(PII_REC_ANONYMIZE)),
        F.lit(PII_REC_COMPLIANCE)))
    return agg.select((F.col("n") > 0).alias("pii_detected"), F.col("n").cast("bigint").alias("total_pii_columns"),
                      recs.alias("recommendations"))
