"""Column-type helpers shared by the operators."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def is_numeric_type(dt: T.DataType) -> bool:
    # Like ``select_dtypes('number')``: numbers and durations, never booleans.
    return isinstance(dt, _NUMERIC) or isinstance(dt, T.DayTimeIntervalType)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_fractional_type(dt: T.DataType) -> bool:
    return isinstance(dt, _FRACTIONAL)


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def user_columns(df: DataFrame) -> list[str]:
    """All columns except the internal row label."""
    return [c for c in df.columns if c != ROW_ID]


def numeric_columns(df: DataFrame, cols: list[str] | None = None, include_intervals: bool = False) -> list[str]:
    """Numeric columns (never booleans).  Durations count as numbers in pandas
    but no statistic here applies to them, so they are left out by default."""
    wanted = set(cols) if cols else None
    return [f.name for f in df.schema.fields
            if f.name != ROW_ID and is_numeric_type(f.dataType)
            and (include_intervals or not isinstance(f.dataType, T.DayTimeIntervalType))
            and (wanted is None or f.name in wanted)]


def text_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    wanted = set(cols) if cols else None
    return [f.name for f in df.schema.fields
            if f.name != ROW_ID and is_text_type(f.dataType)
            and (wanted is None or f.name in wanted)]


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}")


def qcol(name: str):
    """Column reference that tolerates dots and spaces in the name."""
    return F.col(f"`{name}`") if not name.startswith("`") else F.col(name)


# Decision D1: NaN and NULL are one missing value.  Loaded float columns keep their stored values, so that
# filters on them reach the file, and carry this mark in their metadata; operators that
# compute with values make the mark good first (settled), filters split it off (present).
NAN_IS_MISSING = "nan_is_missing"


def mark_nan(df: DataFrame) -> DataFrame:
    """Mark the float columns of a loaded table: their NaN is a missing value."""
    return df.select(*[qcol(f.name).alias(f.name, metadata={**f.metadata, NAN_IS_MISSING: True})
                       if is_fractional_type(f.dataType) else qcol(f.name) for f in df.schema.fields])


def marked_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get(NAN_IS_MISSING) and is_fractional_type(f.dataType)]


def value(df: DataFrame, name: str):
    """The column with NaN as NULL if it is marked."""
    f = df.schema[name]
    marked = f.metadata.get(NAN_IS_MISSING) and is_fractional_type(f.dataType)
    return F.when(~F.isnan(qcol(name)), qcol(name)) if marked else qcol(name)


def settled(df: DataFrame) -> DataFrame:
    """``df`` with NaN as NULL in its marked columns, which lose the mark."""
    marked = marked_columns(df)
    return df.withColumns({c: value(df, c) for c in marked}) if marked else df


def settles(fn):
    """For operators whose first argument is a table: settle it first."""
    @functools.wraps(fn)
    def run(df, *args, **kw):
        return fn(settled(df) if isinstance(df, DataFrame) else df, *args, **kw)
    return run


def present(df: DataFrame, cols):
    """AND of ``IsNotNull`` per column: unlike ``na.drop`` (``atleastnnonnulls``) these predicates
    are pushed down to the Parquet scan; marked columns add a NaN test of their own."""
    conds = [qcol(c).isNotNull() for c in cols] + [~F.isnan(qcol(c)) for c in marked_columns(df) if c in cols]
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


def all_present(cols):
    """AND of ``IsNotNull`` per column: unlike ``na.drop`` (``atleastnnonnulls``)
    these predicates are pushed down to the Parquet scan."""
    conds = [qcol(c).isNotNull() for c in cols]
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)
