"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this process where a local session has none."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-tessera-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in an order over the whole table: sorted by ranges, then numbered within each
    partition on from the rows of the partitions before it. Only the sizes of partitions, a row each, meet in one task."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return placed.join(ahead, "_part").withColumn(name, F.col("_ahead") + F.col("_in") + 1).drop("_part", "_in", "_ahead")


#: For steps whose rows are long: what stands ready for each Python worker, on both sides, is that much and no more.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What runs inside runs with these settings of its session."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def let_go() -> None:
    """Gives memory that a Python worker holds free back to the system: workers stay when their task has ended."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: worked out once however often it is read, and lineage ends there."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> bool:
    """Removes a folder or file of any file system that Spark can write to; False if there is none."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A name for the present state of some tables on disk: paths, sizes and times of their files. No file is read."""
    mark = hashlib.sha256()
    for path in paths:
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        mark.update(repr([path, files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()]).encode())
    return mark.hexdigest()[:24]
