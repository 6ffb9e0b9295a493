"""Operators the reference's README promises: rename, type conversion,
value counts and histograms (drop_missing_columns and fill_mode live in
``missing``; ``read_txt`` in ``sources.readers``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import qcol, require_columns, settles


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    require_columns(df, list(mapping))
    return df.withColumnsRenamed(mapping)


@settles
def convert_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Cast columns to Spark SQL types; values that do not convert become NULL."""
    require_columns(df, list(mapping))
    return df.withColumns({c: qcol(c).try_cast(t) for c, t in mapping.items()})


@settles
def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Frequency of each value, most frequent first (ties by value)."""
    base = df.where(qcol(col).isNotNull()) if dropna else df
    return (base.groupBy(qcol(col).alias(col)).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last(col)))


@settles
def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max]: bin, lower, upper, count.

    Bin i covers [lower, upper); the last bin also holds the maximum.  Empty
    bins are reported with count 0.  One stats job, then one partial aggregate.
    """
    st = df.agg(F.min(qcol(col)).alias("lo"), F.max(qcol(col)).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint")
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins if hi > lo else 1.0
    x = qcol(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)) + 1
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"),
                    F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
            .orderBy("bin"))
