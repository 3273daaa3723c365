"""Tables on disk whose rows are replaced by key as one step (A3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recovery import SMALL_BATCHES, removed, settings

BUCKETS = 64
#: Rows that lie by bucket are written with some files open at once instead of being sorted first; how rows are stored.
IN_PLACE = {"spark.sql.maxConcurrentOutputFileWriters": "8", **SMALL_BATCHES}
STORED = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
_POINTERS = "step long, bucket int, batch string"


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


class KeyedTables:
    """Tables of one folder that share a key and are replaced together.

    Keys are dealt into buckets. A batch writes the new rows of all buckets that it touches into a folder of its own, and at
    last one file that points these buckets to it. Readers follow the newest pointer of each bucket, so they see all of a
    batch or nothing; a bucket without rows left is pointed to a folder that has none for it. A batch that failed before its
    pointers leaves the old rows readable, and may run again; one that is done changes nothing when it runs again.

    One writer at a time. ``tables``: name -> schema, each with the key column. A folder keeps the number of buckets that its
    first batch had; what is collected is at most a row for each bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], key: str = "target_version", buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.tables, self.key, self.buckets = spark, folder.rstrip("/"), tables, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema(_POINTERS).parquet(f"{self.folder}/pointers")
        except Exception as e:
            if _missing(e):
                return self.spark.createDataFrame([], _POINTERS)
            raise

    def _state(self) -> tuple[int, set[str], dict[str, list[int]]]:
        """(last step, batches that are done, buckets by the batch that they point to)."""
        rows = self._pointers()
        done = {r["batch"]: r["step"] for r in rows.select("batch", "step").distinct().collect()}
        live: dict[str, list[int]] = {}
        for r in rows.groupBy("bucket").agg(F.max_by("batch", "step").alias("batch")).collect():
            live.setdefault(r["batch"], []).append(r["bucket"])
        return max(done.values(), default=0), set(done), live

    def exists(self) -> bool:
        return bool(self._state()[1])

    def _rows(self, name: str, live: dict[str, list[int]]) -> DataFrame:
        columns = self.spark.createDataFrame([], self.tables[name]).columns
        try:
            rows = self.spark.read.schema(f"{self.tables[name]}, batch string, bucket int").parquet(f"{self.folder}/rows/{name}")
        except Exception as e:
            if _missing(e):
                return self.spark.createDataFrame([], self.tables[name])
            raise
        shown = F.lit(False)
        for batch, buckets in live.items():
            shown = shown | ((F.col("batch") == batch) & F.col("bucket").isin(buckets))
        return rows.filter(shown).select(columns)

    def read(self, name: str) -> DataFrame:
        """The rows of a table as they are now; later batches don't change what this DataFrame reads."""
        return self._rows(name, self._state()[2])

    def replace(self, batch: str, keys: DataFrame, **new: DataFrame) -> bool:
        """Replaces all rows of the listed keys by the new ones, in all tables; a key without new rows is evicted. New rows of
        other keys and of null keys are left out. False if this batch has been done before."""
        step, done, live = self._state()
        if batch in done:
            return False
        listed = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        touched = sorted(r[0] for r in listed.select(self._bucket().alias("b")).distinct().collect())
        before = {b: [x for x in buckets if x in set(touched)] for b, buckets in live.items()}
        before = {b: buckets for b, buckets in before.items() if buckets}
        for name in self.tables:
            rows = self._rows(name, before).join(listed, self.key, "left_anti") if before else self.spark.createDataFrame([], self.tables[name])
            if name in new:
                rows = rows.unionByName(new[name].join(listed, self.key, "left_semi").select(rows.columns))
            rows = rows.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", *rows.columns[:1])
            rows.write.mode("overwrite").options(**STORED).partitionBy("bucket").parquet(f"{self.folder}/rows/{name}/batch={batch}")
        self._point(step + 1, touched, batch)
        return True

    def rebuild(self, batch: str, rows: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> bool:
        """Replaces all rows of the keys of ``rows`` by what ``build`` makes of them. As ``replace``, but what is built must have the
        key of the row that it is built from: each row moves once, before it is built, and what is built is written where it lies.
        ``build`` may leave out or multiply rows; those with a null key are left out."""
        rows = rows.filter(F.col(self.key).isNotNull())
        step, done, live = self._state()
        if batch in done:
            return False
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())
        if any(set(touched) & set(buckets) for buckets in live.values()):  # old rows are in the way
            return self.replace(batch, rows, **build(rows))
        made = build(rows.withColumn("_bucket", self._bucket()).repartition("_bucket").drop("_bucket")) if touched else {}
        for name, schema in self.tables.items():
            new = made.get(name, self.spark.createDataFrame([], schema))
            new = new.select(self.spark.createDataFrame([], schema).columns).withColumn("bucket", self._bucket())
            with settings(new.sparkSession, IN_PLACE):
                new.write.mode("overwrite").options(**STORED).partitionBy("bucket").parquet(f"{self.folder}/rows/{name}/batch={batch}")
        self._point(step + 1, touched, batch)
        return True

    def _point(self, step: int, touched: list[int], batch: str) -> None:
        pointers = self.spark.createDataFrame([(step, b, batch) for b in touched] or [(step, None, batch)], _POINTERS)
        pointers.coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")

    def vacuum(self) -> list[str]:
        """Removes the folders of batches that no bucket points to any more; not while others read. Gives their batches."""
        _, done, live = self._state()
        gone = sorted(b for b in done if b not in live)
        for batch in gone:
            for name in self.tables:
                removed(self.spark, f"{self.folder}/rows/{name}/batch={batch}")
        return gone
