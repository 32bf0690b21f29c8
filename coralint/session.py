"""Session settings used by the tests, the bench and the examples."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "coralint", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Local or cluster session with the settings the jobs are tuned for.

    The advisory partition size is small because one megabyte of source text
    becomes several megabytes of token rows after ``posexplode``.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
        if "local" in master:
            b = b.config("spark.driver.memory", os.environ.get("CORALINT_DRIVER_MEMORY", "12g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def partitions_for(df: DataFrame, bytes_per_partition: int, capped: bool = True) -> int:
    """Partitions for a table by its estimated size, up to ``spark.sql.shuffle.partitions`` if ``capped``.

    Never fewer than the cores at hand; an unknown size gives the configured number. Without the cap,
    for files of known size, a partition stays as large however many there are.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(spark.sparkContext.defaultParallelism, -(-size // bytes_per_partition))
    return max(1, min(most, wanted) if capped else wanted)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own, else a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="coralint-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def _hadoop_path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def absolute_path(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that every reader and writer means the same folder."""
    place, fs = _hadoop_path(spark, path)
    return fs.makeQualified(place).toString().rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    place, fs = _hadoop_path(spark, path)
    fs.delete(place, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, now and not at some later collection."""
    gc.collect()
    spark._jvm.System.gc()
