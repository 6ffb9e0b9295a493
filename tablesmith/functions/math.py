"""Arithmetic helpers with Python operator semantics.

Spark runs with ANSI mode on, where ``/`` by zero raises; these helpers use
``try_divide`` so a zero divisor gives NULL (decision D10) instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


INTEGRAL_TYPES = ["tinyint", "smallint", "int", "bigint"]


def nan_to_null(col) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


def true_div(a, b) -> Column:
    """``a / b`` as floating division; zero divisor -> NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def floor_div(a, b) -> Column:
    """Python ``//``: rounds toward minus infinity (``-7 // 2 == -4``).

    Two integers divide as integers (exact beyond 2**53); anything else as
    doubles.  The types are known when the plan is analyzed, so the choice
    costs nothing per row."""
    a, b = _c(a), _c(b)
    ai, bi = a.try_cast("bigint"), b.try_cast("bigint")
    down = F.when((ai % bi != 0) & ((ai < 0) != (bi < 0)), F.lit(1)).otherwise(F.lit(0))
    whole = F.when(bi != 0, F.call_function("div", ai, bi) - down)
    integers = F.typeof(a).isin(INTEGRAL_TYPES) & F.typeof(b).isin(INTEGRAL_TYPES)
    return F.when(integers, whole).otherwise(F.floor(true_div(a, b)))


def floor_mod(a, b) -> Column:
    """Python ``%``: result takes the sign of the divisor (``-7 % 2 == 1``)."""
    a, b = _c(a), _c(b)
    return a - b * floor_div(a, b)


def power(a, b) -> Column:
    return nan_to_null(F.pow(_c(a), _c(b)))


# numpy-style names accepted by the calculated-column helpers -> Spark function.
MATH_FUNCTIONS = {
    "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": F.log, "log1p": F.log1p,
    "log10": F.log10, "abs": F.abs, "floor": F.floor, "ceil": F.ceil,
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
}


def math_fn(name: str, col) -> Column:
    """Apply a numpy-named math function; out-of-domain NaN becomes NULL."""
    try:
        fn = MATH_FUNCTIONS[name]
    except KeyError:
        raise ValueError(f"unknown math function {name!r}") from None
    return nan_to_null(fn(_c(col)))


def arctan2(y, x) -> Column:
    return nan_to_null(F.atan2(_c(y), _c(x)))


# SQL-bodied temporary functions (inlined by the analyzer: no UDF at run time)
# so calculated-column expressions can spell Python operator semantics.
SQL_FUNCTIONS = {
    "true_div": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(a, b)",
    "floor_div": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN floor(try_divide(a, b))",
    "floor_mod": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a - b * floor(try_divide(a, b))",
    "arcsin": "(x DOUBLE) RETURNS DOUBLE RETURN nullif(asin(x), double('NaN'))",
    "arccos": "(x DOUBLE) RETURNS DOUBLE RETURN nullif(acos(x), double('NaN'))",
    "arctan": "(x DOUBLE) RETURNS DOUBLE RETURN atan(x)",
    "arcsinh": "(x DOUBLE) RETURNS DOUBLE RETURN asinh(x)",
    "arccosh": "(x DOUBLE) RETURNS DOUBLE RETURN nullif(acosh(x), double('NaN'))",
    "arctanh": "(x DOUBLE) RETURNS DOUBLE RETURN nullif(atanh(x), double('NaN'))",
    "arctan2": "(y DOUBLE, x DOUBLE) RETURNS DOUBLE RETURN atan2(y, x)",
}

def register_sql_functions(spark) -> None:
    """Register the helpers above in ``spark`` (temporary functions are per session)."""
    if spark.catalog.functionExists("floor_mod") and spark.catalog.functionExists("arctan2"):
        return
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
