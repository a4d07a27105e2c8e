"""Session settings shared by tests, the benchmark and stand-alone jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_WRITTEN: dict[int, str] = {}


def local_session(app: str = "questlog", cpus: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session inside one process may fall back to a folder of this machine."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/questlog-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared checkpoint folder and read it back.

    Used where a result is read several times. Unlike a cache it survives the loss of executors, and unlike
    a checkpointed RDD later readers still get column pruning, filter pushdown and size statistics.
    """
    spark = df.sparkSession
    target = scratch_path(spark)
    df.write.parquet(target)
    out = spark.read.schema(df.schema).parquet(target)
    _WRITTEN[id(out)] = target
    weakref.finalize(out, _WRITTEN.pop, id(out), None)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that `materialise` wrote, once nothing reads them any more."""
    for df in frames:
        target = _WRITTEN.pop(id(df), None)
        if target:
            jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(hadoop).delete(path, True)
