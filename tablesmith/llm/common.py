"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Words are runs of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


_OPEN: list = []  # paths of the tables stored in each open scratch() scope


def stored(df: DataFrame, name: str, keep: bool = False, large: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor rereads the table instead of recomputing
    it) and costs one computation, unlike an eager checkpoint.  The innermost
    scratch() scope deletes the table, or with ``keep`` the scope around it;
    outside of any, the caller may once its results are written.  After a
    ``large`` one the shuffle files that led to it are let go.
    """
    path = scratch_path(df.sparkSession, name)
    level = len(_OPEN) - 1 - keep
    if level >= 0:
        _OPEN[level].append(path)
    df.write.option("compression", "zstd").parquet(path)
    if large:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held.

    It does so when the driver collects its garbage, else every 30 minutes: late
    for a chain of large jobs whose results are stored.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at the end, but for those stored with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        release(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(col: str) -> F.Column:
    """The words of a text column (an empty array for null)."""
    return F.coalesce(F.regexp_extract_all(F.col(col), F.lit(WORD_RE), F.lit(0)),
                      F.array().cast("array<string>"))


def slices(batch, column: int, max_bytes: int = 8 << 20):
    """Split an Arrow batch into runs of rows of at most ``max_bytes`` in one
    string/binary column (a longer single row stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
