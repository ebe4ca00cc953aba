"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a job wants whatever the cluster defaults are.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

LOCAL_CHECKPOINT_FALLBACK = "/tmp/hookline-checkpoints"
JIT_FLAG = "-XX:-DontCompileHugeMethods"


def get_spark(master: str | None = None, app: str = "hookline",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one (local mode only in tests)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", "16g")
        # let HotSpot JIT-compile the large generated projection methods
        # (set the same flag in spark.executor.extraJavaOptions on a cluster)
        builder = builder.config("spark.driver.extraJavaOptions", JIT_FLAG)
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session (the cluster's shared
    storage). Only when nothing is configured (local tests) a folder is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        target = LOCAL_CHECKPOINT_FALLBACK
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove one scratch table or folder by its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables (``materialize``, stream
    sinks); call when the job's results are written."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        p = spark._jvm.org.apache.hadoop.fs.Path(base)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of each query when it ends.

    For jobs of many steps, each of which writes its result to the shared
    folder: no later step reads the shuffles of an earlier one.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: one pass over the input, lineage cut, and retries after an
    executor loss read the written files instead of recomputing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
