"""Calculated columns.

The reference evaluates pandas expressions; here the expression language is
Spark SQL (``F.expr``) or a ``Column``.  Python operator semantics that SQL
spells differently are available as helpers in ``functions.math``
(``true_div``, ``floor_div``, ``floor_mod``, ``power``, numpy-named math),
and by the same names inside SQL text (``"floor_div(a, 7)"``): they are
registered as SQL-bodied temporary functions, which the analyzer inlines.
Method calls and object access of the pandas form are not supported (D16).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import register_sql_functions
from ..functions.types import is_fractional_type, settles


@settles
def calculated_column(df: DataFrame, name: str, expression) -> DataFrame:
    """Add or overwrite column ``name`` with ``expression`` (SQL text or Column)."""
    if not name or expression is None or (isinstance(expression, str) and not expression.strip()):
        raise ValueError(f"calculated_column: name={name!r} with expression={expression!r} defines no column")
    if not isinstance(expression, Column):
        register_sql_functions(df.sparkSession)
    col = expression if isinstance(expression, Column) else F.expr(expression)
    out = df.withColumn(name, col)
    if is_fractional_type(out.schema[name].dataType):
        out = df.withColumn(name, F.when(~F.isnan(col), col))   # out-of-domain results are missing (D1)
    return out
