"""Shared helpers: scratch tables in the shared checkpoint folder, table readers."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


#: a setting, Spark's default, and what a stage takes instead
SMALL_BATCHES = (
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "256"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation
    that could come out in another order.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Small batches for what follows, Arrow's of few MB and the Parquet reader's of few rows: Spark's are held for every
    task at once, in the JVM and in Python, and are larger the longer the texts.  A launcher's own setting stays."""
    for key, default, small in SMALL_BATCHES:
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column, NULL as no bytes."""
    return F.coalesce(F.encode(F.col(column), "UTF-8"), F.lit(b""))


def tidy() -> None:
    """Free what a Python worker would hold beyond a task, as Spark uses workers again for other stages:
    the packing operator's caches, garbage, and memory that the allocators keep."""
    pack = sys.modules.get("tessera.llm.pack")
    if pack is not None:
        pack._KEPT.clear()
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):            # another C library
        pass


def tidied(task):
    """A worker function over batches that leaves its worker tidy, however it ends."""
    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            tidy()

    return run


def tidied_group(task):
    """The same for a function of one group."""
    @functools.wraps(task)
    def run(table):
        try:
            return task(table)
        finally:
            tidy()

    return run
