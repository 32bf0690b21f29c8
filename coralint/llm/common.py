"""Small helpers shared by the operators: tables, written intermediates, exact row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.session import ensure_checkpoint_dir

# Rows of one Arrow batch; texts of 100 kB each then still fit a Python worker many times over.
ROWS_PER_BATCH = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage, computes a frame that several branches use once, and survives lost executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def give_back() -> None:
    """Return freed memory of this worker to the system; workers outlive their tasks and share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library offers it
        ctypes.CDLL(None).malloc_trim(0)


def hash128(*columns: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes; nulls differ from empty values."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(1_000_003), *parts)
