"""Unpivoted cells of a table, counted in one pass with fixed-width keys.

A cell is (slot, a, b): a column's number, a 64-bit key of the value and a second,
independent 64-bit hash.  Numbers, dates and booleans are their own key (or one
that is reversible), so only texts and nested values are hashed; whole texts are never a
shuffle key.  ``Expand`` (SQL's UNPIVOT) makes the cells inside generated code, and
partial aggregation collapses repeated ones before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import qcol

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def comparable(df: DataFrame, name: str) -> Column:
    """The column as a value that groups and hashes as its equality asks (maps and nested values by their JSON)."""
    dt, c = df.schema[name].dataType, qcol(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))  # -0.0 equals 0.0 as a number
    if isinstance(dt, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(c)
    return c


def keys(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The (a, b) of a column's cells; a is null for a missing value."""
    dt, c = df.schema[name].dataType, qcol(name)
    exact = F.lit(0).cast("long")
    if isinstance(dt, _WHOLE):
        return c.cast("long"), exact
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c), exact
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long"), exact
    value = comparable(df, name)
    a = F.when(value.isNotNull(), F.xxhash64(value))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return a, exact  # the hash of one double is reversible
    return a, F.xxhash64(F.lit(name), value, F.octet_length(value.cast("string")))


def unpivoted(rows: DataFrame, cells: list[dict[str, Column]]) -> DataFrame:
    """One row (slot, *names) for each of ``cells`` and row; all cells name the same columns."""
    names = list(cells[0])
    flat = rows.select(*[c.alias(f"__{n}_{i}") for i, cell in enumerate(cells) for n, c in [("slot", F.lit(i)), *cell.items()]])
    sets = ", ".join(f"({', '.join(f'`__{n}_{i}`' for n in ['slot', *names])}) AS `{i}`" for i in range(len(cells)))
    listed = ", ".join(f"`{n}`" for n in names)
    return rows.sparkSession.sql(f"SELECT slot, {listed} FROM {{flat}} UNPIVOT INCLUDE NULLS "
                                 f"((slot, {listed}) FOR __name IN ({sets}))", flat=flat)
