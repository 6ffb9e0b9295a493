"""Preview: filters, sorted view, paging, cell edits, labels, summary.

A page is a top-k (``TakeOrderedAndProject``) of ``limit`` rows, however deep it
lies: its first and last row are found as order statistics of the sort key
and row label alone, and a range filter between them reaches the scan.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (check_regex, format_phone, python_float_text, python_pattern_to_java,
                              python_timestamp_text)
from ..functions.types import (ROW_ID, is_text_type, present, qcol, settled, settles, user_columns,
                               value)
from ..session import scratch_tables, stored_table

# ---------------------------------------------------------------------------
# Default page size of the preview.
DEFAULT_PAGE_SIZE = 50
# ---------------------------------------------------------------------------


EDIT_ORDER = "edit_no"


def _as_text(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    col = qcol(c)
    if isinstance(dt, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return python_timestamp_text(col)
    if isinstance(dt, T.DoubleType):
        return python_float_text(col)
    if isinstance(dt, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    return col.cast("string")


@settles
def global_filter(df: DataFrame, pattern: str | None, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where any column's text contains ``pattern`` (case-insensitive
    regex).  Missing never matches (D2).  Row-wise: stream-safe."""
    if not pattern:
        return df
    cols = cols or user_columns(df)
    regex = check_regex("(?idU)" + python_pattern_to_java(pattern))
    conds = [F.coalesce(_as_text(df, c).rlike(regex), F.lit(False)) for c in cols]
    return df.where(functools.reduce(operator.or_, conds)) if conds else df


@settles
def column_filter(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Per-column case-insensitive substring boxes, ANDed.  Stream-safe."""
    conds = []
    for c, text in (filters or {}).items():
        if text is None or text == "":
            continue
        conds.append(F.coalesce(F.lower(_as_text(df, c)).contains(text.lower()), F.lit(False)))
    return df.where(functools.reduce(operator.and_, conds)) if conds else df


def range_filter(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows whose value lies in ``[low, high]`` (None: open); missing never matches.  The range
    reaches the file, also on loaded float columns, whose NaN is sieved beside it.  Stream-safe."""
    if column not in df.columns:
        raise ValueError(f"range filter: no column {column!r}")
    conds = [present(df, [column])]
    if low is not None:
        conds.append(qcol(column) >= F.lit(low))
    if high is not None:
        conds.append(qcol(column) <= F.lit(high))
    return df.where(functools.reduce(operator.and_, conds))


def count_matching(df: DataFrame) -> int:
    return df.count()


def page_count(total: int, size: int = DEFAULT_PAGE_SIZE) -> int:
    return max(1, math.ceil(total / size))


def clamp_page(page: int, total: int, size: int = DEFAULT_PAGE_SIZE) -> int:
    return min(max(1, page), page_count(total, size))


@settles
def sort_view(df: DataFrame, sort_by: str | None, order: str = "asc") -> DataFrame:
    """Stable one-column sort, NULLs last both ways; unknown column ignored."""
    if not sort_by or sort_by not in df.columns:
        return df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    key = qcol(sort_by).asc_nulls_last() if order == "asc" else qcol(sort_by).desc_nulls_last()
    ties = [F.col(ROW_ID).asc()] if ROW_ID in df.columns else []
    return df.orderBy(key, *ties)


def _keys(df: DataFrame, sort_by) -> list[str]:
    """The sort columns that exist; ``sort_by`` is a name or a list of names."""
    names = [sort_by] if isinstance(sort_by, str) else list(sort_by or [])
    return [c for c in names if c in df.columns]


def _ordering(columns: list, label, order: str) -> list:
    by = [x.asc_nulls_last() if order == "asc" else x.desc_nulls_last() for x in columns]
    return [*by, label.asc()]


def boundaries(df: DataFrame, start: int, stop: int, sort_by=None, order: str = "asc") -> tuple | None:
    """``((keys, label), (keys, label))`` of the rows at 0-based ranks ``start`` and ``stop - 1`` (or the last
    row) in view order; None beyond the end.

    Only sort keys and row label are read, range-partitioned in order and
    stored; one count per partition tells which partitions hold the ranks,
    and only these are numbered."""
    spark, names = df.sparkSession, _keys(df, sort_by)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{i}" for i, _ in enumerate(names)]
    slim = df.select(*[_carried(df, c).alias(k) for c, k in zip(names, keys)], F.col(ROW_ID).alias("__label"))
    by = _ordering([F.col(k) for k in keys], F.col("__label"), order)
    with scratch_tables(spark):
        parts = stored_table(slim.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()), "page-keys")
        counts = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
        total = sum(size for _, size in counts)
        if start >= total:
            return None
        ranks, wanted, seen = (start, min(stop, total) - 1), {}, 0
        for part, size in counts:
            wanted |= {r: (part, r - seen + 1) for r in ranks if seen <= r < seen + size}
            seen += size
        numbered = parts.where(F.col("__part").isin([p for p, _ in wanted.values()])).withColumn(
            "__at", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
        hit = functools.reduce(operator.or_, [(F.col("__part") == p) & (F.col("__at") == k) for p, k in wanted.values()])
        rows = {(r["__part"], r["__at"]): (r[:len(keys)], r["__label"])
                for r in numbered.where(hit).select(*keys, "__label", "__part", "__at").collect()}  # two rows
        return tuple(rows[wanted[r]] for r in ranks)


def _carried(df: DataFrame, name: str):
    """Timestamps travel through the driver as microseconds, whatever its time zone."""
    return F.unix_micros(qcol(name)) if isinstance(df.schema[name].dataType, T.TimestampType) else value(df, name)


def _between(df: DataFrame, first: tuple, last: tuple, names: list[str], order: str):
    """Rows from ``first`` to ``last`` in view order; the first key's own range is a conjunct of its own."""
    def lit(name, v):
        dt = df.schema[name].dataType
        return F.timestamp_micros(F.lit(v)) if isinstance(dt, T.TimestampType) else F.lit(v).cast(dt)

    def after(x, v):
        return x > v if order == "asc" else x < v

    def before(x, v):
        return x < v if order == "asc" else x > v

    start, end = F.col(ROW_ID) >= first[1], F.col(ROW_ID) <= last[1]
    for c, low, high in reversed(list(zip(names, first[0], last[0]))):
        x = value(df, c)
        # missing keys come last: nothing follows them
        start = (x.isNull() & start if low is None else
                 x.isNull() | after(x, lit(c, low)) | ((x == lit(c, low)) & start))
        end = (x.isNotNull() | end if high is None else
               before(x, lit(c, high)) | ((x == lit(c, high)) & end))
    if names and first[0][0] is not None and last[0][0] is not None:
        x, low, high = qcol(names[0]), lit(names[0], first[0][0]), lit(names[0], last[0][0])
        low, high = (low, high) if order == "asc" else (high, low)
        return (x >= low) & (x <= high) & start & end
    if names and first[0][0] is None:
        return value(df, names[0]).isNull() & start & end
    return start & end


def page(df: DataFrame, page_no: int = 1, limit: int = DEFAULT_PAGE_SIZE, sort_by=None, order: str = "asc") -> DataFrame:
    """1-based page of ``df`` in view order: by ``sort_by`` (a name or names), missing keys last, then by row label.

    The first page is a top-k.  Any other one lies between two boundary rows (see
    boundaries()): a range filter on the first sort key, pushed to the scan where the type allows, leaves
    the page's rows and rows that tie with its ends, and a top-k of ``limit`` rows orders
    them.  No task holds more than its partition of the keys, and nothing but keys is written.  Sort
    keys of nested types, and tables without row labels, take Spark's own offset."""
    start, names = (max(1, int(page_no)) - 1) * limit, _keys(df, sort_by)
    labelled = ROW_ID in df.columns
    keys = [value(df, c) for c in names]
    by = _ordering(keys, F.col(ROW_ID), order) if labelled else [
        x.asc_nulls_last() if order == "asc" else x.desc_nulls_last() for x in keys]
    nested = any(isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) for c in names)
    if not start or nested or not labelled:
        view = df.orderBy(*by) if by else df
        return view.offset(start).limit(limit) if start else view.limit(limit)
    ends = boundaries(df, start, start + limit, names, order)
    if ends is None:
        return df.where(F.lit(False))
    return df.where(_between(df, *ends, names, order)).orderBy(*by).limit(limit)


def preview(df: DataFrame, page_no: int = 1, limit: int = DEFAULT_PAGE_SIZE,
            sort_by: str | None = None, sort_order: str = "asc",
            filter_val: str | None = None) -> DataFrame:
    """filter -> sort -> page -> phone formatting on the page only -> ``original_index``."""
    view = global_filter(df, filter_val)
    view = settled(page(view, page_no, limit, sort_by, sort_order))
    phones = [f.name for f in view.schema.fields
              if "phone" in f.name.lower() and is_text_type(f.dataType)]
    if phones:
        view = view.withColumns({c: format_phone(qcol(c)) for c in phones})
    if ROW_ID in view.columns:
        view = view.withColumnRenamed(ROW_ID, "original_index")
        view = view.select("original_index", *[qcol(c) for c in view.columns if c != "original_index"])
    return view


@settles
def edit_cell(df: DataFrame, row_id: int, column: str, value) -> DataFrame:
    """Point update by row label; the value is cast to the column type (D3).
    Unknown column raises; unknown label changes nothing."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    dt = df.schema[column].dataType
    new = F.lit(value).try_cast(dt) if value is not None else F.lit(None).cast(dt)
    return df.withColumn(column, F.when(F.col(ROW_ID) == F.lit(row_id), new).otherwise(qcol(column)))


@settles
def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Batch edits: ``edits`` has ``_row_id``, the columns to overwrite (NULL =
    keep) and optionally ``edit_no``.  Several edits of one label become one
    row first: per column the last non-NULL value by ``edit_no`` (without it,
    in the order of the rows), so no row is multiplied.  To empty cells, see apply_cell_edits()."""
    cols = [c for c in edits.columns if c not in (ROW_ID, EDIT_ORDER)]
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    typed = edits.select(F.col(ROW_ID).alias("__eid"),
                         (F.col(EDIT_ORDER) if EDIT_ORDER in edits.columns else F.monotonically_increasing_id()).alias("__no"),
                         *[qcol(c).try_cast(df.schema[c].dataType).alias(f"__e_{i}") for i, c in enumerate(cols)])
    e = typed.groupBy("__eid").agg(*[
        F.max_by(f"__e_{i}", F.when(F.col(f"__e_{i}").isNotNull(), F.col("__no"))).alias(f"__e_{i}")
        for i, _ in enumerate(cols)])
    joined = df.join(e, F.col(ROW_ID) == F.col("__eid"), "left")
    out = joined.withColumns({c: F.coalesce(F.col(f"__e_{i}"), qcol(c)) for i, c in enumerate(cols)})
    return out.select(*[qcol(c) for c in df.columns])


@settles
def apply_cell_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Batch edits cell by cell: ``edits`` has ``_row_id``, ``column``, ``value`` (text, cast to the column's type as
    in edit_cell(); NULL empties the cell) and optionally ``edit_no``.  The last edit of a cell by ``edit_no``
    counts (without it, in the order of the rows); unknown labels change nothing, an unknown column raises."""
    asked = [r[0] for r in edits.select("column").distinct().limit(len(df.columns) + 1).collect()]
    unknown = [c for c in asked if c not in df.columns]
    if unknown:
        raise ValueError(f"apply_cell_edits: no column {unknown[0]!r}")
    number = F.col(EDIT_ORDER) if EDIT_ORDER in edits.columns else F.monotonically_increasing_id()
    rows = edits.select(F.col(ROW_ID).alias("__eid"), F.col("column").alias("__column"), number.alias("__no"),
                        F.struct(F.col("value").cast("string").alias("v")).alias("__value"))
    last = rows.groupBy("__eid").agg(*[
        F.max_by("__value", F.when(F.col("__column") == c, F.col("__no"))).alias(f"__e_{i}") for i, c in enumerate(asked)])
    joined = df.join(last, F.col(ROW_ID) == F.col("__eid"), "left")
    out = joined.withColumns({c: F.when(F.col(f"__e_{i}").isNotNull(), F.col(f"__e_{i}.v").try_cast(df.schema[c].dataType))
                              .otherwise(qcol(c)) for i, c in enumerate(asked)})
    return out.select(*[qcol(c) for c in df.columns])


def title_label(name: str) -> str:
    """snake_case -> Title Case header label: underscores become spaces and
    the first character of every word is upper-cased (the rest is kept)."""
    return re.sub(r"\b\w", lambda m: m.group(0).upper(), name.replace("_", " "), flags=re.ASCII)


def title_labels(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: title_label(c) for c in user_columns(df)})


@settles
def table_summary(df: DataFrame) -> DataFrame:
    """``df.info()``: one row per column with non-NULL count and type (one job)."""
    cols = user_columns(df)
    counts = df.agg(*[F.count(qcol(c)).cast("bigint").alias(f"n{i}") for i, c in enumerate(cols)])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("position"), F.lit(c).alias("column"),
                 F.col(f"n{i}").alias("non_null"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


@settles
def table_head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(ROW_ID).limit(n) if ROW_ID in df.columns else df.limit(n)
