"""Row-wise cleaning on streaming DataFrames.

The reference has no streaming.  Its row-wise operators (filters, text
cleaning, validation, constant fill, calculated columns, drop-missing) are
pure projections/filters, so they run unchanged on a Structured Streaming
DataFrame; operators that need statistics over the whole table (mean or
median fill, IQR, dedup, sort, profile) are not stream-safe and are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import expr, missing, preview, text
from ..sources.writers import format_phone_columns

# Operators that are pure per-row projections or filters.
STREAM_SAFE: set[Callable] = {
    preview.global_filter, preview.column_filter, preview.edit_cell,
    missing.drop_missing, missing.fill_value,
    text.string_op, text.trim, text.lower, text.upper, text.title_case, text.find_replace,
    text.validate_emails, text.format_phones, text.strip_markdown, text.split_segments,
    expr.calculated_column, format_phone_columns,
}


def is_stream_safe(fn: Callable) -> bool:
    return fn in STREAM_SAFE


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream source; the schema defaults to the current files' schema.

    A path to a single file streams its folder, restricted to that file name."""
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hp) and fs.getFileStatus(hp).isFile():
        return r.option("pathGlobFilter", hp.getName()).load(hp.getParent().toString())
    return r.load(path)


def clean_stream(df: DataFrame, steps: list[tuple[Callable, dict]]) -> DataFrame:
    """Apply ``[(operator, kwargs), ...]``; refuses operators that need the whole table."""
    out = df
    for fn, kwargs in steps:
        if not is_stream_safe(fn):
            raise ValueError(f"{getattr(fn, '__name__', fn)} needs the whole table; not stream-safe")
        out = fn(out, **(kwargs or {}))
    return out


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Start an append-mode file sink.  ``checkpoint`` is the stream's own folder on shared
    storage: a restart with the same one goes on where the stream stopped."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
