"""Missing values: drop rows, fill with mean / median / mode / constant,
forward and backward fill, drop sparse columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_integral_type, numeric_columns, present, qcol, settles, user_columns
from ..plans import fill as fill_plan
from ..plans.cells import unpivoted
from ..plans.quantile import from_sketches, quantiles, sketches
from .rowid import order_columns


def _targets(df: DataFrame, cols) -> list[str]:
    return list(cols) if cols else user_columns(df)


def drop_missing(df: DataFrame, cols=None) -> DataFrame:
    """Drop a row if any target column is missing.  Stream-safe."""
    return df.where(present(df, _targets(df, cols)))


def _fill_with_stats(df: DataFrame, stats: dict, nulls: dict) -> DataFrame:
    updates = {}
    for c, v in stats.items():
        if v is None or not nulls.get(c):
            continue   # nothing missing (or nothing to fill with): column unchanged
        x = qcol(c)
        if is_integral_type(df.schema[c].dataType):
            x = x.cast("double")   # pandas holds a gappy int column as float
        updates[c] = F.coalesce(x, F.lit(float(v)))
    return df.withColumns(updates) if updates else df


@settles
def fill_mean(df: DataFrame, cols=None) -> DataFrame:
    """Numeric targets only; mean ignores missing.  One aggregate job."""
    targets = numeric_columns(df, _targets(df, cols))
    if not targets:
        return df
    row = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(targets)],
                 *[F.count_if(qcol(c).isNull()).alias(f"z{i}") for i, c in enumerate(targets)]).first()
    return _fill_with_stats(df, {c: row[f"m{i}"] for i, c in enumerate(targets)},
                            {c: row[f"z{i}"] for i, c in enumerate(targets)})


@settles
def fill_median(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Numeric targets only; linear-interpolated median (exact, bounded memory)."""
    targets = numeric_columns(df, _targets(df, cols))
    if not targets:
        return df
    nulls = df.agg(*[F.count_if(qcol(c).isNull()).alias(f"z{i}") for i, c in enumerate(targets)],
                   *(sketches(targets, [0.5]) if exact else [])).first()
    med = from_sketches(df, nulls, targets, [0.5]) if exact else quantiles(df, targets, [0.5], exact=False)
    return _fill_with_stats(df, {c: med[c][0] for c in targets},
                            {c: nulls[f"z{i}"] for i, c in enumerate(targets)})


@settles
def fill_value(df: DataFrame, value, cols=None) -> DataFrame:
    """Constant into all targets, cast to each column's type (D4); a column
    the value cannot be cast to is left alone.  ``None`` is a no-op."""
    if value is None:
        return df
    updates = {c: F.coalesce(qcol(c), F.lit(value).try_cast(df.schema[c].dataType))
               for c in _targets(df, cols)}
    return df.withColumns(updates)


@settles
def forward_fill(df: DataFrame, cols=None, order_by=None, partition_by=None,
                 rows_per_block: int = fill_plan.DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Last non-missing value above in row order (leading gap stays)."""
    return fill_plan.fill(df, _targets(df, cols), order_columns(df, order_by), partition_by,
                          backward=False, rows_per_block=rows_per_block)


@settles
def backward_fill(df: DataFrame, cols=None, order_by=None, partition_by=None,
                  rows_per_block: int = fill_plan.DEFAULT_ROWS_PER_BLOCK) -> DataFrame:
    """Next non-missing value below in row order (trailing gap stays)."""
    return fill_plan.fill(df, _targets(df, cols), order_columns(df, order_by), partition_by,
                          backward=True, rows_per_block=rows_per_block)


def handle_missing(df: DataFrame, method: str = "remove", cols=None, fill_value_=None, **kw) -> DataFrame:
    """Dispatcher with the reference's method names; unknown method raises."""
    methods = {
        "remove": lambda: drop_missing(df, cols),
        "fill_mean": lambda: fill_mean(df, cols),
        "fill_median": lambda: fill_median(df, cols),
        "fill_value": lambda: fill_value(df, fill_value_, cols),
        "forward_fill": lambda: forward_fill(df, cols, **kw),
        "backward_fill": lambda: backward_fill(df, cols, **kw),
        "fill_mode": lambda: fill_mode(df, cols),
    }
    if method not in methods:
        raise ValueError(f"handle_missing: method {method!r} is not one of {sorted(methods)}")
    return methods[method]()


# Typed slots of a mode's cells: how a type's values become a slot's, in order, and come back.
_SLOTS = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType), "l", lambda c: c.cast("long"), lambda v, dt: v.cast(dt)),
    ((T.DateType,), "l", lambda c: F.unix_date(c).cast("long"), lambda v, dt: F.date_from_unix_date(v.cast("int"))),
    ((T.TimestampType,), "l", F.unix_micros, lambda v, dt: F.timestamp_micros(v)),
    ((T.FloatType, T.DoubleType), "d", lambda c: c.cast("double"), lambda v, dt: v.cast(dt)),
    ((T.DecimalType,), "n", lambda c: c.cast("decimal(38,18)"), lambda v, dt: v.cast(dt)),
    ((T.StringType, T.VarcharType, T.CharType, T.TimestampNTZType), "s", lambda c: c.cast("string"), lambda v, dt: v.cast(dt)),
    ((T.BinaryType,), "b", lambda c: c, lambda v, dt: v),
]
_SLOT_TYPES = {"l": "bigint", "d": "double", "n": "decimal(38,18)", "s": "string", "b": "binary"}


def _slot(dt):
    if isinstance(dt, T.DecimalType) and (dt.scale > 18 or dt.precision - dt.scale > 20):
        return None
    return next((x[1:] for x in _SLOTS if isinstance(dt, x[0])), None)


def _modes(df: DataFrame, cols: list[str]) -> dict:
    """The most frequent non-missing value of each column as a Column (none for columns without values).

    One scan and one shuffle for all columns of plain types: a cell is a column number and five typed slots, of
    which one is set, however many columns there are.  Equal cells are counted with partial
    aggregation; the greatest count, then the smallest value, is a partial aggregate too.  Nested columns are
    counted one by one; maps, which have no order, have no mode."""
    plain = [c for c in cols if _slot(df.schema[c].dataType)]
    out = {}
    if plain:
        made = []
        for c in plain:
            name, to, _ = _slot(df.schema[c].dataType)
            made.append({k: to(qcol(c)) if k == name else F.lit(None).cast(t) for k, t in _SLOT_TYPES.items()})
        counts = (unpivoted(df, made).where(functools.reduce(operator.or_, [F.col(k).isNotNull() for k in _SLOT_TYPES]))
                  .groupBy("slot", *_SLOT_TYPES).agg((-F.count("*")).alias("less")))
        top = counts.groupBy("slot").agg(F.min(F.struct("less", *_SLOT_TYPES)).alias("top"))
        for r in top.collect():  # one row a column
            c = plain[r["slot"]]
            name, _, back = _slot(df.schema[c].dataType)
            out[c] = back(F.lit(r["top"][name]).cast(_SLOT_TYPES[name]), df.schema[c].dataType)
    for c in cols:
        dt = df.schema[c].dataType
        if c in plain or "map<" in dt.simpleString():
            continue
        top = (df.where(qcol(c).isNotNull()).groupBy(qcol(c).alias("v")).agg((-F.count("*")).alias("n"))
               .agg(F.min(F.struct("n", "v")).alias("top")).select(F.to_json(F.struct(F.col("top.v").alias("v")),
                                                                   {"ignoreNullFields": "false"}).alias("j"),
                                                                   F.col("top").isNotNull().alias("any")).first())
        if top["any"]:
            out[c] = F.from_json(F.lit(top["j"]), T.StructType([T.StructField("v", dt)])).getField("v")
    return out


@settles
def mode_values(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-missing value per column, ties -> smallest; None without values."""
    cols = [c for c in cols if "map<" not in df.schema[c].dataType.simpleString()]
    found = _modes(df, cols)
    if not found:
        return dict.fromkeys(cols)
    row = df.sparkSession.range(1).select(*[v.alias(f"v{i}") for i, v in enumerate(found.values())]).first()
    values = dict(zip(found, row))
    return {c: values.get(c) for c in cols}


@settles
def fill_mode(df: DataFrame, cols=None) -> DataFrame:
    """Missing cells become their column's most frequent value (see _modes())."""
    modes = _modes(df, _targets(df, cols))
    return df.withColumns({c: F.coalesce(qcol(c), v) for c, v in modes.items()}) if modes else df


@settles
def drop_missing_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose missing fraction exceeds ``threshold`` (0..1).  One job."""
    cols = user_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(qcol(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    n = row["__n"]
    if not n:
        return df
    drop = [c for i, c in enumerate(cols) if row[f"z{i}"] / n > threshold]
    return df.drop(*drop) if drop else df
