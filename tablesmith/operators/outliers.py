"""IQR and z-score outliers.

Bounds for all columns come from one quantile computation (exact,
bounded-memory, see ``plans.quantile``); the row-wise part is then a plain
projection or filter with the bounds as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import ROW_ID, is_integral_type, numeric_columns, qcol, settles
from ..plans.quantile import quantiles
from ..session import scratch_tables, stored_table

# ---------------------------------------------------------------------------
# IQR fence factor and z-score limit.
IQR_FACTOR = 1.5
ZSCORE_LIMIT = 3.0
# ---------------------------------------------------------------------------


@settles
def iqr_bounds(df: DataFrame, cols=None, exact: bool = True) -> dict[str, tuple]:
    """``{col: (q1, q3, lower, upper)}`` with Q1 - 1.5 IQR and Q3 + 1.5 IQR."""
    targets = numeric_columns(df, cols)
    qs = quantiles(df, targets, [0.25, 0.75], exact=exact)
    out = {}
    for c in targets:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr)
    return out


@settles
def iqr_bounds_frame(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Bounds as a DataFrame: one row per column (derived from ``df``)."""
    b = iqr_bounds(df, cols, exact)
    names = list(b)
    return df.sparkSession.createDataFrame(
        [(c, *[None if v is None else float(v) for v in b[c]]) for c in names],
        "column string, q1 double, q3 double, lower_bound double, upper_bound double")


def _mask(c: str, lo, hi):
    x = qcol(c)
    return (x < F.lit(lo)) | (x > F.lit(hi))


@settles
def outliers_remove(df: DataFrame, cols=None, exact: bool = True, with_count: bool = False):
    """Remove rows outside the bounds, column by column; each column's
    quartiles are taken after the previous columns' rows were removed
    (reference semantics).

    The target columns are stored once; all quartiles and counts come from
    that narrow table, two passes a column, and the table itself is read for it once.  The
    result is one chain of filters on ``df``."""
    targets, affected, bounds = numeric_columns(df, cols), 0, {}
    with scratch_tables(df.sparkSession):
        left = df.select(*[qcol(c) for c in targets])
        if len(targets) > 1:
            left = stored_table(left, "outlier-columns")
        for c in targets:
            lo, hi = iqr_bounds(left, [c], exact)[c][2:]
            if lo is None:
                continue
            out = _mask(c, lo, hi)
            if with_count:
                affected += left.where(out).count()
            left, bounds[c] = left.where(~out | qcol(c).isNull()), (lo, hi)
    for c, (lo, hi) in bounds.items():
        df = df.where(~_mask(c, lo, hi) | qcol(c).isNull())
    return (df, affected) if with_count else df


@settles
def outlier_counts(df: DataFrame, bounds: dict) -> dict[str, tuple[int, int]]:
    """``{col: (below, above)}`` in one aggregate."""
    live = {c: b for c, b in bounds.items() if b[2] is not None}
    if not live:
        return {c: (0, 0) for c in bounds}
    aggs = []
    for i, (c, (_, _, lo, hi)) in enumerate(live.items()):
        aggs += [F.count_if(qcol(c) < F.lit(lo)).alias(f"lo{i}"), F.count_if(qcol(c) > F.lit(hi)).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    out = {c: (0, 0) for c in bounds}
    out.update({c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(live)})
    return out


@settles
def outliers_nullify(df: DataFrame, cols=None, exact: bool = True, bounds: dict | None = None) -> DataFrame:
    """Outlier cells become NULL; columns are independent (one bounds computation)."""
    bounds = bounds if bounds is not None else iqr_bounds(df, cols, exact)
    updates = {c: F.when(~_mask(c, lo, hi) | qcol(c).isNull(), qcol(c))
               for c, (_, _, lo, hi) in bounds.items() if lo is not None}
    return df.withColumns(updates) if updates else df


@settles
def outliers_cap(df: DataFrame, cols=None, exact: bool = True, bounds: dict | None = None,
                 counts: dict | None = None) -> DataFrame:
    """Winsorise to the bounds.  An integer column stays integer unless a
    fractional bound is actually written into it (then it becomes double)."""
    bounds = bounds if bounds is not None else iqr_bounds(df, cols, exact)
    counts = counts if counts is not None else outlier_counts(df, bounds)
    updates = {}
    for c, (_, _, lo, hi) in bounds.items():
        if lo is None:
            continue
        below, above = counts[c]
        x = qcol(c)
        capped = F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
        if is_integral_type(df.schema[c].dataType):
            written = ([lo] if below else []) + ([hi] if above else [])
            if not written:
                continue
            if all(float(v).is_integer() for v in written):
                updates[c] = capped.cast(df.schema[c].dataType)
                continue
        updates[c] = capped.cast("double")
    return df.withColumns(updates) if updates else df


@settles
def handle_outliers(df: DataFrame, method: str = "remove", cols=None, exact: bool = True):
    """Dispatcher; returns ``(DataFrame, outliers_affected)``.  Unknown method raises (D5)."""
    if method == "remove":
        return outliers_remove(df, cols, exact, with_count=True)
    if method not in ("nullify", "cap"):
        raise ValueError(f"unknown outlier method {method!r}")
    bounds = iqr_bounds(df, cols, exact)
    counts = outlier_counts(df, bounds)
    affected = sum(a + b for a, b in counts.values())
    out = (outliers_nullify(df, bounds=bounds) if method == "nullify"
           else outliers_cap(df, bounds=bounds, counts=counts))
    return out, affected


@settles
def iqr_outliers(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Rows outside the IQR bounds: row label, value, bounds."""
    q1, q3, lo, hi = iqr_bounds(df, [col], exact)[col]
    if lo is None:
        return df.where(F.lit(False)).select(F.col(ROW_ID), qcol(col).alias("value"),
                                            F.lit(None).cast("double").alias("lower_bound"),
                                            F.lit(None).cast("double").alias("upper_bound"))
    return df.where(_mask(col, lo, hi)).select(
        F.col(ROW_ID), qcol(col).alias("value"),
        F.lit(float(lo)).alias("lower_bound"), F.lit(float(hi)).alias("upper_bound"))


@settles
def zscore_outliers(df: DataFrame, col: str, limit: float = ZSCORE_LIMIT) -> DataFrame:
    """Rows with ``|x - mean| / std > limit`` (sample std); a constant column has none."""
    st = df.agg(F.avg(qcol(col)).alias("m"), F.stddev_samp(qcol(col)).alias("s")).first()
    if st["s"] is None or st["s"] == 0:
        return df.where(F.lit(False)).select(F.col(ROW_ID), qcol(col).alias("value"),
                                            F.lit(None).cast("double").alias("zscore"))
    z = (qcol(col) - F.lit(st["m"])) / F.lit(st["s"])
    return df.where(F.abs(z) > F.lit(limit)).select(F.col(ROW_ID), qcol(col).alias("value"), z.alias("zscore"))
