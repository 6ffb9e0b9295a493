"""Spark session and shared-storage settings.

On a cluster the session already exists and carries its own settings; the
helpers here only fill in what is missing, so a cluster's choices (shuffle
partitions, checkpoint folder) always win over the local defaults used by
tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Defaults for a session this package creates itself (tests, bench, local use).
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tablesmith", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS") or "8"
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("TABLESMITH_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    A cluster sets ``spark.checkpoint.dir`` to storage every executor can
    reach; we use it as given.  Only a local session (tests, the bench) with
    the setting unset gets a private scratch folder; on a cluster an unset
    setting is an error rather than a machine-local folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    master = sc.master or ""
    if not (master == "local" or master.startswith("local[")):   # local-cluster[...] has separate executors
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set: on a cluster it must name shared storage "
                           "that every executor can reach")
    local = tempfile.mkdtemp(prefix="tablesmith-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


_OPEN: list = []  # paths of the tables stored in each open scratch_tables() scope


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back:
    cuts lineage like a checkpoint, but computes the plan once and keeps its size known.
    The innermost scratch_tables() scope deletes it; outside of any it stays, as the
    result that reads it is not computed yet."""
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables stored inside are deleted at the end: for operators that return small values, not plans."""
    _OPEN.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used by multi-pass operators so that a lost executor re-reads the
    checkpoint instead of recomputing the whole upstream plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
