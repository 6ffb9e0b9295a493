"""Exact per-group quantiles (linear interpolation) of several columns at once.

Spark's ``median`` / ``percentile`` keep every distinct value of a group in one
in-memory buffer.  Here no task holds a group:

1. one pass unpivots the columns and counts equal (group, column, value)
   rows (partial aggregation collapses repeated values map-side);
2. the counts are range-partitioned by (group, column, value), so a hot group
   spreads over as many partitions as its values need, and stored with
   their partition's number;
3. cumulative counts inside a partition plus the totals of the partitions
   before (one row per partition and group) give every value its ranks;
4. the values at ranks floor/ceil(p * (n - 1)) are picked and interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import all_present, qcol
from ..session import stored_table


def ranged(counts: DataFrame, order: list[str]) -> DataFrame:
    """``counts`` range-partitioned by ``order`` and stored with the number of its partition in ``__part``."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored_table(counts.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "value-counts")


def with_ends(counts: DataFrame, group: list[str], *order: str) -> DataFrame:
    """``counts`` (of ranged(); rows __n) with ``__end``, the rows of its group up to and with it in
    ``order``, and ``__all``, the rows of its group."""
    totals = counts.groupBy(*group, "__part").agg(F.sum("__n").alias("__in"))
    parts = Window.partitionBy(*group)
    before = parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__part", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"),
                           F.sum("__in").over(parts).alias("__all"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("__end", F.sum("__n").over(inside)).join(totals, [*group, "__part"])
            .withColumn("__end", F.col("__end") + F.col("__before")))


def group_quantiles(df: DataFrame, keys: list[str], columns: dict[str, str], p: float = 0.5) -> DataFrame:
    """(keys..., one column per name in ``columns``): the exact p-quantile of each column per group.
    Groups whose values are all NULL get NULL; rows with a NULL key are dropped."""
    k = [f"__k{i}" for i in range(len(keys))]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), qcol(c).cast("double").alias("v"))
                                for i, c in enumerate(columns)])).alias("cell")
    rows = (df.where(all_present(keys)).select(*[qcol(c).alias(a) for c, a in zip(keys, k)], cells)
            .select(*k, F.col("cell.c").alias("__c"), F.col("cell.v").alias("__v")))
    counts = ranged(rows.groupBy(*k, "__c", "__v").agg(F.count(F.lit(1)).alias("__n")), [*k, "__c", "__v"])
    group = [*k, "__c"]
    ranked = with_ends(counts.where(F.col("__v").isNotNull()), group, "__v")
    at = F.lit(p) * (F.col("__all") - 1)
    start = F.col("__end") - F.col("__n")
    value_at = lambda rank: F.max(F.when((start <= rank) & (rank < F.col("__end")), F.col("__v")))
    picked = ranked.groupBy(*group, at.alias("__at")).agg(value_at(F.floor(at)).alias("__lo"),
                                                          value_at(F.ceil(at)).alias("__hi"))
    low, high = F.floor("__at"), F.ceil("__at")
    value = F.when(low == high, F.col("__lo")).otherwise(
        (high - F.col("__at")) * F.col("__lo") + (F.col("__at") - low) * F.col("__hi"))
    values = picked.select(*group, value.alias("__q"))
    # every group, those without any value included
    groups = counts.select(*k).distinct()
    wide = values.groupBy(*k).agg(*[F.max(F.when(F.col("__c") == i, F.col("__q"))).alias(f"__q{i}")
                                    for i, _ in enumerate(columns)])
    out = groups.join(wide, k, "left")
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)],
                      *[F.col(f"__q{i}").alias(name) for i, name in enumerate(columns.values())])
