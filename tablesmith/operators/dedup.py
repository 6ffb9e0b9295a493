"""Duplicate rows: keep-first removal and counts.

Rows are first split by a 64-bit hash of their key: keys whose hash occurs
once cannot repeat and pass straight through (anti-join against the repeated
hashes, a stored table); only the rest go through the exact plan below.

Keep-first on a subset is ``groupBy(subset).agg(min_by(struct(rest), order))``:
``min_by`` has a partial aggregate, so a hot subset value is reduced map-side
to one candidate per input partition before the shuffle.
(``dropDuplicates(subset)`` would keep an arbitrary row.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import ROW_ID, qcol, require_columns, settles, user_columns
from ..plans.duplicates import HASH, candidate_hashes, duplicate_rows


@settles
def drop_duplicates(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Keep the first row (in ``order_by``, default row label) of each duplicate set.
    Missing equals missing.  ``subset`` None or empty = all columns.

    Rows whose key hash is unique pass through; only rows sharing a key hash
    (the real duplicates, plus rare collisions) are de-duplicated exactly."""
    keys = list(subset) if subset else user_columns(df)
    require_columns(df, keys)
    keyed, cand = candidate_hashes(df, keys)
    # the stored candidates' size is known: Spark broadcasts them if they are few and else joins by shuffle
    unique_rows = keyed.join(cand, HASH, "left_anti").drop(HASH)
    dup_rows = keyed.join(cand, HASH, "left_semi").drop(HASH)
    return unique_rows.unionByName(_drop_duplicates_direct(dup_rows, subset, order_by))


def _drop_duplicates_direct(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    subset = list(subset) if subset else []
    require_columns(df, subset)
    cols = user_columns(df)
    order = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not order and ROW_ID in df.columns:
        order = [ROW_ID]
    keys = subset or cols
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    if not order:
        if not subset:
            return df.dropDuplicates()
        raise ValueError("keep-first on a subset needs order_by or a row label")
    if rest == order and len(order) == 1:
        # the only non-key column is the order itself: a hash-aggregated min
        first = df.groupBy(*[qcol(k) for k in keys]).agg(F.min(qcol(order[0])).alias(order[0]))
        return first.select(*[qcol(c) for c in df.columns])
    ord_key = F.struct(*[qcol(c) for c in order]) if len(order) > 1 else qcol(order[0])
    picked = df.groupBy(*[qcol(k) for k in keys]).agg(
        F.min_by(F.struct(*[qcol(c) for c in rest]), ord_key).alias("__first"))
    return picked.select(*[qcol(c) if c in keys else F.col(f"__first.`{c}`").alias(c)
                           for c in df.columns])


@settles
def count_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """One row: rows minus distinct rows (``duplicated().sum()``).

    Exact, via the two-phase hash plan (``plans.duplicates``): only rows whose
    64-bit row hash repeats are shuffled in full."""
    keys = list(subset) if subset else user_columns(df)
    dups = duplicate_rows(df, keys)
    return df.agg(F.lit(dups).cast("bigint").alias("duplicate_rows"))


def duplicates_removed(before: DataFrame, after: DataFrame) -> int:
    return before.count() - after.count()
