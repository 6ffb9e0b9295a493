"""Profiling and quality scores.

All figures of a table come from two scans (``statistics``): one keyless aggregate
for counts, moments and the medians' sketches, and one pass over unpivoted cells
(``plans.cells``) that counts distinct values, repeated rows and the values
near the medians.  ``profile_dataset`` alone needs one.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import qcol, settles, user_columns
from ..plans.cells import keys, unpivoted
from ..plans.distinct import count_keys, distinct_counts, repeated_rows, row_key
from ..plans.quantile import from_sketches, quantiles, region, sketches
from ..session import scratch_tables, stored_table

# ---------------------------------------------------------------------------
# Placeholder sub-scores, band limits and recommendation texts.
CONSISTENCY_SCORE = 85
VALIDITY_SCORE = 90
BANDS = [(90, "excellent"), (70, "good"), (50, "fair")]
LOWEST_BAND = "poor"
COMPLETENESS_MIN = 80
UNIQUENESS_MIN = 90
REC_MISSING = "Consider handling missing values"
REC_DUPLICATES = "Remove duplicate rows to improve data quality"
REC_PII = "PII data detected - consider anonymization"
# ---------------------------------------------------------------------------

_STAT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
               T.DecimalType)


@settles
def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: total_rows, total_columns, missing_cells, duplicate_rows.

    One scan: rows are grouped by two 64-bit hashes, of which only the first is
    a shuffle key, with their counts of rows and of missing cells."""
    cols = user_columns(df)
    a, b = row_key(df, cols)
    rows = df.select(a.alias("a"), b.alias("b"), _missing(cols).alias("z"))
    grouped = rows.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"),
                                    F.sum("z").alias("z"))
    with scratch_tables(df.sparkSession):
        grouped = stored_table(grouped, "row-keys")
        row = grouped.agg(F.sum("n").alias("n"), F.sum("z").alias("z")).first()
        return _dataset(df, row["n"] or 0, len(cols), row["z"] or 0, repeated_rows(df, cols, grouped))


def _missing(cols):
    return functools.reduce(operator.add, [qcol(c).isNull().cast("long") for c in cols], F.lit(0).cast("long"))


def _dataset(df: DataFrame, *values) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [values], "total_rows bigint, total_columns bigint, missing_cells bigint, duplicate_rows bigint")


def score_band(score) -> "F.Column":
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for limit, name in BANDS:
        expr = (F.when(s >= limit, F.lit(name)) if expr is None else expr.when(s >= limit, F.lit(name)))
    return expr.otherwise(F.lit(LOWEST_BAND))


@settles
def quality_score(df: DataFrame, dataset: DataFrame | None = None) -> DataFrame:
    """One row: completeness, uniqueness, consistency, validity, overall (2 dp) and band."""
    ds = dataset if dataset is not None else profile_dataset(df)
    cells = F.col("total_rows") * F.col("total_columns")
    completeness = F.greatest(F.lit(0.0), 100 - F.try_divide(F.col("missing_cells") * 100.0, cells))
    uniqueness = F.greatest(F.lit(0.0), 100 - F.try_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows")))
    overall = (completeness + uniqueness + CONSISTENCY_SCORE + VALIDITY_SCORE) / 4
    return ds.select(
        F.round(overall, 2).alias("overall_score"),
        F.round(completeness, 2).alias("completeness_score"),
        F.round(uniqueness, 2).alias("uniqueness_score"),
        F.lit(float(CONSISTENCY_SCORE)).alias("consistency_score"),
        F.lit(float(VALIDITY_SCORE)).alias("validity_score"),
    ).withColumn("band", score_band("overall_score"))


def quality_recommendations(scores: DataFrame, pii_detected=False) -> DataFrame:
    """One row with the recommendation list; ``pii_detected`` is a bool or a Column."""
    pii = pii_detected if not isinstance(pii_detected, bool) else F.lit(pii_detected)
    recs = F.array_compact(F.array(
        F.when(F.col("completeness_score") < COMPLETENESS_MIN, F.lit(REC_MISSING)),
        F.when(F.col("uniqueness_score") < UNIQUENESS_MIN, F.lit(REC_DUPLICATES)),
        F.when(pii, F.lit(REC_PII))))
    return scores.select(recs.alias("recommendations"))


def row_quality(dataset: DataFrame) -> DataFrame:
    """Chart series: clean vs duplicate rows."""
    return dataset.select(F.explode(F.array(
        F.struct(F.lit("Clean Rows").alias("label"), (F.col("total_rows") - F.col("duplicate_rows")).alias("count")),
        F.struct(F.lit("Duplicate Rows").alias("label"), F.col("duplicate_rows").alias("count")))).alias("s")
    ).select("s.label", F.col("s.count").cast("bigint").alias("count"))


def cell_quality(dataset: DataFrame) -> DataFrame:
    """Chart series: valid vs missing cells."""
    cells = F.col("total_rows") * F.col("total_columns")
    valid = F.when(cells > 0, cells - F.col("missing_cells")).otherwise(F.lit(0))
    return dataset.select(F.explode(F.array(
        F.struct(F.lit("Valid Cells").alias("label"), valid.alias("count")),
        F.struct(F.lit("Missing Cells").alias("label"), F.col("missing_cells").alias("count")))).alias("s")
    ).select("s.label", F.col("s.count").cast("bigint").alias("count"))


def _stat_columns(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if isinstance(df.schema[c].dataType, _STAT_TYPES)]


@settles
def statistics(df: DataFrame, probs=(0.5,), approx_distinct: bool = False, exact: bool = True, rows: bool = False):
    """The figures of every column, and of whole rows if asked: ``(facts, distinct, quantiles, repeated)``.

    ``facts`` is the row of the first scan: __rows and by column number z (missing), mn, mx, av, sd.
    """
    cols = user_columns(df)
    num = _stat_columns(df, cols)
    aggs = [F.count("*").alias("__rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(qcol(c).isNull()).alias(f"z{i}"))
        if c in num:
            x = qcol(c).cast("double")
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                     F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    facts = df.agg(*aggs, *(sketches(num, probs) if exact else [])).first()
    if approx_distinct:
        distinct = {r["column"]: r["unique_count"] for r in distinct_counts(df, cols, approx=True).collect()}
        return facts, distinct, quantiles(df, num, probs, exact), None
    with scratch_tables(df.sparkSession):
        made = [dict(zip("ab", keys(df, c)), v=(qcol(c) if c in num else F.lit(None)).cast("double")) for c in cols]
        if rows:
            made.append(dict(zip("ab", row_key(df, cols)), v=F.lit(None).cast("double")))
        found = unpivoted(df, made).where("a IS NOT NULL").groupBy("slot", "a").agg(
            F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"), F.max("v").alias("v"))
        found = stored_table(found, "cells")
        of_columns = found.where(F.col("slot") < len(cols))
        counts = count_keys(df, cols, of_columns)
        repeated = repeated_rows(df, cols, found.where(F.col("slot") == len(cols))) if rows else None

        def counted(_, of):
            part = F.lit(None).cast("int")
            where = F.lit(None).cast("int")
            for s, (c, b) in enumerate(of.items()):
                here = F.col("slot") == cols.index(c)
                part, where = F.when(here, s).otherwise(part), F.when(here, region(F.col("v"), b)).otherwise(where)
            rows = of_columns.select(part.alias("slot"), where.alias("region"), "v", "n").where("slot IS NOT NULL")
            return rows.groupBy("slot", "region", F.expr("IF(region % 2 = 1, v, NULL)").alias("v")).agg(F.sum("n").alias("__n"))

        middle = from_sketches(df, facts, num, probs, counted) if exact else quantiles(df, num, probs, False)
    return facts, {c: counts.get(i, 0) for i, c in enumerate(cols)}, middle, repeated


_COLUMNS = """position int, column string, dtype string, unique_count bigint, null_count bigint, null_pct double,
  min double, max double, mean double, std double, median double"""


@settles
def profile_columns(df: DataFrame, approx_distinct: bool = False, exact_median: bool = True) -> DataFrame:
    """One row per column: position, column, dtype, unique_count, null_count,
    null_pct (2 dp), and for numeric columns min, max, mean, std, median."""
    return _columns(df, *statistics(df, [0.5], approx_distinct, exact_median)[:3])


def _columns(df: DataFrame, facts, distinct: dict, middle: dict) -> DataFrame:
    rows = []
    for i, c in enumerate(user_columns(df)):
        own = [facts[f"{k}{i}"] for k in ("mn", "mx", "av", "sd")] + middle[c] if c in middle else [None] * 5
        rows.append((i, c, df.schema[c].dataType.simpleString(), distinct.get(c, 0), facts[f"z{i}"], None, *own))
    made = df.sparkSession.createDataFrame(rows, _COLUMNS)
    percent = F.round(F.try_divide(F.col("null_count") * 100.0, F.lit(facts["__rows"])), 2)
    return made.withColumn("null_pct", percent).orderBy("position")


@settles
def numeric_stats(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Per numeric column: count, min, q25, median, q75, max, mean, std."""
    num = _stat_columns(df, list(cols) if cols else user_columns(df))
    probs = [0.25, 0.5, 0.75]
    aggs = sketches(num, probs) if exact else []
    for i, c in enumerate(num):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    schema = "column string, count bigint, min double, q25 double, median double, q75 double, max double, mean double, std double"
    if not num:
        return df.sparkSession.createDataFrame([], schema)
    row = df.agg(*aggs).first()
    qs = from_sketches(df, row, num, probs) if exact else quantiles(df, num, probs, False)
    return df.sparkSession.createDataFrame(
        [(c, row[f"n{i}"], row[f"mn{i}"], *qs[c], row[f"mx{i}"], row[f"av{i}"], row[f"sd{i}"]) for i, c in enumerate(num)],
        schema)


@settles
def profile(df: DataFrame, pii_sample_size: int = 100):
    """The full profile: (dataset row, column rows, quality row, recommendations row, pii rows)."""
    from .pii import pii_sample
    facts, distinct, middle, repeated = statistics(df, [0.5], rows=True)
    names = user_columns(df)
    ds = _dataset(df, facts["__rows"], len(names), sum(facts[f"z{i}"] for i, _ in enumerate(names)), repeated)
    cols = _columns(df, facts, distinct, middle)
    scores = quality_score(df, ds)
    pii = pii_sample(df, n=pii_sample_size)
    detected = pii.agg((F.count(F.lit(1)) > 0).alias("d")).first()["d"]
    return ds, cols, scores, quality_recommendations(scores, bool(detected)), pii
