"""Forward / backward fill without a single-task window.

A window with no PARTITION BY sends every row to one task.  Instead:

1. Range-partition the rows by the order (NULLs first, the row label as tie
   breaker), sort each partition and store it.  The cuts come from a sample
   of the rows, so partitions have equal row counts whatever the key's
   values: far sentinels, NULL keys and repeated keys do not swell one.  A
   row's stored place (partition, position) is its order in every later step.
2. A partition is cut into *blocks* of ``rows_per_block`` rows.  Small blocks
   share a task and a file: their number costs neither.
3. Fill inside each (group, block) with an ordinary window.
4. Per (group, block) take the last non-NULL value (``max_by``, which has a
   partial aggregate) - a table of #groups x #blocks rows; the same per
   (group, partition).
5. A running ``last(ignorenulls)`` over the blocks of a partition, and one
   over the partitions, give each block the value carried in.
6. Join the carry back on (group, block) and ``coalesce(local, carry)``.

Backward fill is the mirror image.  The result equals the single-window
answer (tested), but no task holds more than one block's rows, one partition's
blocks or one value per partition.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import ROW_ID, qcol
from ..session import stored_table

BLOCK = "__blk"
PLACE = "__place"
PLACE_BITS = 33               # of monotonically_increasing_id: the position in the partition
DEFAULT_ROWS_PER_BLOCK = 1 << 20


def in_blocks(df: DataFrame, order_by: list[str], rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """``df``, stored, with its place in the order in PLACE and its block in BLOCK; both ascend in the order.

    The high bits of both are the partition, of which there are as many as blocks, but no more than
    the session's shuffles have or blocks of the default size need."""
    n = df.count()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // DEFAULT_ROWS_PER_BLOCK))
    order = [qcol(c).asc_nulls_first() for c in order_by]
    rows = df.repartitionByRange(max(1, min(tasks, -(-n // rows_per_block))), *order).sortWithinPartitions(*order)
    tmp = stored_table(rows.withColumn(PLACE, F.monotonically_increasing_id()), "fill-blocks")
    position = F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return tmp.withColumn(BLOCK, F.col(PLACE) - position + F.floor(position / rows_per_block))


def fill(df: DataFrame, cols: list[str], order_by: list[str], partition_by: list[str] | None = None,
         backward: bool = False, rows_per_block: int = DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    partition_by = list(partition_by or [])
    if not cols:
        return df
    order_by = order_by + ([ROW_ID] if ROW_ID in df.columns and ROW_ID not in order_by else [])
    tmp = in_blocks(df, order_by, rows_per_block)

    groups = [qcol(p) for p in partition_by]
    edge_fn = F.min_by if backward else F.max_by

    def running(parts, order, start, columns):
        """Each of ``columns``: the nearest non-NULL value, from ``start`` rows away (0: the row itself) on.

        Backward fill turns the order: a frame that ends at the last row would be read anew for every row."""
        w = Window.partitionBy(*parts).orderBy(F.col(order).desc() if backward else F.col(order))
        w = w.rowsBetween(Window.unboundedPreceding, -start)
        return [F.last(c, ignorenulls=True).over(w) for c in columns]

    def edges_of(rows, parts, order, columns):
        """Edge value of each part: last (forward) / first (backward) non-NULL in order."""
        return rows.groupBy(*parts).agg(*[edge_fn(c, F.when(c.isNotNull(), F.col(order))).alias(f"__edge_{i}")
                                          for i, c in enumerate(columns)])

    def matched(names):
        return [qcol(p).eqNullSafe(F.col(n)) for p, n in zip(partition_by, names)]

    values = [qcol(c) for c in cols]
    edge = [F.col(f"__edge_{i}") for i, _ in enumerate(cols)]
    local = tmp.withColumns(dict(zip(cols, running(groups + [F.col(BLOCK)], PLACE, 0, values))))

    part = F.shiftright(BLOCK, PLACE_BITS).alias("__part")
    edges = edges_of(tmp, groups + [F.col(BLOCK)], PLACE, values).withColumn("__part", part)
    inside = edges.select(*groups, BLOCK, "__part", *[
        c.alias(f"__in_{i}") for i, c in enumerate(running(groups + [F.col("__part")], BLOCK, 1, edge))])
    totals = edges_of(edges, groups + [F.col("__part")], BLOCK, edge)
    before = totals.select(*[qcol(p).alias(f"__q_{i}") for i, p in enumerate(partition_by)],
                           F.col("__part").alias("__cpart"), *[
        c.alias(f"__before_{i}") for i, c in enumerate(running(groups, "__part", 1, edge))])
    carry = inside.join(before, _all([F.col("__part") == F.col("__cpart")]
                                     + matched([f"__q_{i}" for i, _ in enumerate(partition_by)])))
    carry = carry.select(*[qcol(p).alias(f"__p_{i}") for i, p in enumerate(partition_by)],
                         F.col(BLOCK).alias("__cblk"),
                         *[F.coalesce(F.col(f"__in_{i}"), F.col(f"__before_{i}")).alias(f"__carry_{i}")
                           for i, _ in enumerate(cols)])
    joined = local.join(carry, _all([F.col(BLOCK) == F.col("__cblk")]
                                    + matched([f"__p_{i}" for i, _ in enumerate(partition_by)])), "left")
    filled = joined.withColumns({c: F.coalesce(qcol(c), F.col(f"__carry_{i}")) for i, c in enumerate(cols)})
    return filled.select(*[qcol(c) for c in df.columns])


def _all(conditions):
    return functools.reduce(operator.and_, conditions)
