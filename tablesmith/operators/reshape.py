"""Sort, group-by (every aggregate the reference accepts) and pivot.

All aggregates below except ``nunique`` and ``median`` are declarative, so
Spark computes them partially on the map side: a hot key holding a third of
the rows is reduced to one partial row per input partition before the
shuffle.  ``nunique`` is planned by Spark as a two-level aggregate on
(keys, value), which also splits a hot key.  ``median`` ranks the values of
all groups in one range sort (``plans.group_quantile``) instead of a buffer of
every distinct value of a group.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import ROW_ID, all_present, numeric_columns, qcol, require_columns, settles
from ..plans.group_quantile import group_quantiles


@settles
def sort(df: DataFrame, cols, ascending: bool | list[bool] = True) -> DataFrame:
    """Multi-key sort, NULLs last in both directions.

    The row label is the last sort key: it makes the order total (stable,
    like pandas' mergesort for one key) and lets the range partitioner split
    a key value shared by many rows across several partitions.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    if not cols:
        raise ValueError(f"sort: cols names no column (got {cols!r})")
    require_columns(df, cols)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(cols)
    keys = [qcol(c).asc_nulls_last() if a else qcol(c).desc_nulls_last() for c, a in zip(cols, asc)]
    if ROW_ID in df.columns and ROW_ID not in cols:
        keys.append(F.col(ROW_ID).asc())
    return df.orderBy(*keys)


def _truth(x: Column, df: DataFrame | None, c: str) -> Column:
    """Python's truth of a value: a boolean itself, text if not empty, a number if not zero."""
    dt = df.schema[c].dataType if df is not None else None
    if isinstance(dt, T.BooleanType):
        return x
    if isinstance(dt, T.StringType):
        return F.length(x) > 0
    return x != 0


def _rid():
    return F.col(ROW_ID)


def agg_expr(fn: str, c: str, df: DataFrame | None = None) -> Column:
    """The pandas named aggregate ``fn`` of column ``c`` as a Spark aggregate."""
    x = qcol(c)
    if fn in ("sum", "mean") and df is not None and isinstance(df.schema[c].dataType, T.BooleanType):
        x = x.cast("bigint")   # pandas adds booleans as 0 and 1
    if fn == "sum":
        # pandas: all-missing group sums to 0.
        zero = F.lit(0)
        if df is not None and df.schema[c].dataType.typeName() in ("float", "double"):
            zero = F.lit(0.0)
        return F.coalesce(F.sum(x), zero)
    if fn == "mean":
        return F.avg(x)
    if fn == "min":
        return F.min(x)
    if fn == "max":
        return F.max(x)
    if fn == "count":
        return F.count(x).cast("bigint")
    if fn == "median":
        # one buffer of a group's distinct values: group_by and pivot use group_quantiles instead
        return F.median(x)
    if fn == "approx_median":
        return F.percentile_approx(x, 0.5, 10_000)
    if fn == "std":
        return F.stddev_samp(x)
    if fn == "var":
        return F.var_samp(x)
    if fn == "sem":
        return F.stddev_samp(x) / F.sqrt(F.count(x))
    if fn == "first":
        return F.min_by(x, F.when(x.isNotNull(), _rid()))
    if fn == "last":
        return F.max_by(x, F.when(x.isNotNull(), _rid()))
    if fn == "nunique":
        return F.count_distinct(x).cast("bigint")
    if fn == "size":
        return F.count(F.lit(1)).cast("bigint")
    if fn == "prod":
        return F.coalesce(F.product(x), F.lit(1.0))
    if fn == "any":
        return F.coalesce(F.bool_or(_truth(x, df, c)), F.lit(False))
    if fn == "all":
        return F.coalesce(F.bool_and(_truth(x, df, c)), F.lit(True))
    if fn == "skew":
        n = F.count(x)
        # Spark's skewness is the biased estimator; pandas reports the
        # adjusted Fisher-Pearson one: g1 * sqrt(n(n-1)) / (n-2), n >= 3.
        return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
    if fn == "idxmin":
        # first occurrence of the minimum: order by (value, row label)
        return F.min_by(_rid(), F.when(x.isNotNull(), F.struct(x, _rid())))
    if fn == "idxmax":
        # first occurrence of the maximum: order by (value, -row label)
        return F.max_by(_rid(), F.when(x.isNotNull(), F.struct(x, -_rid())))
    raise ValueError(f"unknown aggregate function {fn!r}")


AGG_FUNCTIONS = ["sum", "mean", "min", "max", "count", "median", "std", "var", "sem", "first",
                 "last", "nunique", "size", "prod", "any", "all", "skew", "idxmin", "idxmax",
                 "approx_median"]


@settles
def group_by(df: DataFrame, keys, agg_col: str | None = None, fn: str | list[str] = "sum") -> DataFrame:
    """Group on ``keys`` (rows with a NULL key are dropped), aggregate, order by keys.

    A list of functions gives one column per target and function, ``<target>_<function>``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError(f"group_by: keys names no column (got {keys!r})")
    require_columns(df, keys)
    if agg_col:
        targets = [agg_col]
    else:
        # Decision D7: every numeric column except the keys.
        targets = [c for c in numeric_columns(df) if c not in keys]
        if not targets:
            raise ValueError("no numeric column to aggregate")
    base = df.where(all_present(keys))
    wanted = [(c, f, c if isinstance(fn, str) else f"{c}_{f}") for c in targets
              for f in ([fn] if isinstance(fn, str) else fn)]
    plain = [(c, f, name) for c, f, name in wanted if f != "median"]
    medians = {c: name for c, f, name in wanted if f == "median"}
    out = None
    if plain or not medians:
        out = base.groupBy(*[qcol(k) for k in keys]).agg(*[agg_expr(f, c, df).alias(name) for c, f, name in plain])
    if medians:
        part = group_quantiles(base, keys, medians, 0.5)
        out = part if out is None else out.join(part, [k for k in keys], "inner")
    out = out.select(*[qcol(k) for k in keys], *[qcol(name) for _, _, name in wanted])
    return out.orderBy(*[qcol(k).asc() for k in keys])


@settles
def group_by_all_numeric(df: DataFrame, keys, fn: str = "sum") -> DataFrame:
    return group_by(df, keys, None, fn)


@settles
def pivot_values(df: DataFrame, columns: str, max_values: int | None = None) -> list:
    """Sorted distinct pivot values (one job): they become the result's columns, so their number is
    the width of every row.  ``max_values`` refuses wider results; there is no limit by default."""
    vals = df.select(qcol(columns)).where(qcol(columns).isNotNull()).distinct().orderBy(qcol(columns))
    vals = (vals.limit(max_values + 1) if max_values else vals).collect()
    if max_values and len(vals) > max_values:
        raise ValueError(f"pivot column {columns!r} has more than {max_values} distinct values")
    return [r[0] for r in vals]


@settles
def pivot(df: DataFrame, index: str, columns: str, values: str, fn: str = "sum",
          pivot_vals: list | None = None, max_values: int | None = None) -> DataFrame:
    """pandas ``pivot_table(..., fill_value=0)``: NULL index/column rows dropped,
    holes filled with 0, index sorted; for aggregates other than sum/count/size
    an index whose every cell is missing disappears."""
    empty = [k for k, v in {"index": index, "columns": columns, "values": values}.items() if not v]
    if empty:
        raise ValueError(f"pivot: no column given for {' and '.join(empty)}")
    base = df.where(all_present([index, columns]))
    if pivot_vals is None:
        pivot_vals = pivot_values(base, columns, max_values)
    if fn == "median":
        cells = group_quantiles(base, [index, columns], {values: "__m"}, 0.5)
        out = cells.groupBy(qcol(index)).pivot(f"`{columns}`", pivot_vals).agg(F.first("__m"))
    else:
        out = base.groupBy(qcol(index)).pivot(f"`{columns}`", pivot_vals).agg(agg_expr(fn, values, df))
    value_cols = [c for c in out.columns if c != index]
    if fn not in ("sum", "count", "size", "nunique") and value_cols:
        out = out.where(functools.reduce(operator.or_, [qcol(c).isNotNull() for c in value_cols]))
    # A hole (absent combination or all-missing cell) becomes 0 of the column's type.
    zero = [F.coalesce(qcol(c), F.lit(0).try_cast(out.schema[c].dataType)).alias(c)
            if isinstance(out.schema[c].dataType, T.NumericType) else qcol(c) for c in value_cols]
    return out.select(qcol(index), *zero).orderBy(qcol(index))
