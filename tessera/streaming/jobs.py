"""Streaming forms: edit log, index upkeep, snapshot ingest, request dedupe, audit counts (L).

Each takes a streaming DataFrame and gives one, or the writer of a stream; state lives in checkpointed state stores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.identity import content_key
from ..operators.text import SECRETS, redaction_counts
from ..sources.keyed import KeyedTables

_INGESTED = "external_id string, seq long, body string, status string, outcome string, fetched_at timestamp"
_KEPT_MS = 86_400_000
_OUTCOME = "note_id string, seq long, action string, outcome string, version_id string, head_id string"


class _EditLog(StatefulProcessor):
    """The head of a note as a value; its versions (id -> digest of the body) and their bodies (digest -> body) as maps, whose
    entries are read and written one by one. A body is kept as a deletion's id is made of it; equal ones are kept once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "id string")
        self.versions = handle.getMapState("versions", "id string", "digest string")
        self.bodies = handle.getMapState("bodies", "digest string", "body string")

    def _entry(self, note: str, head: str | None, e) -> tuple[str, str | None, str | None]:
        """(outcome, id made, new head) of an entry."""
        parent = e.parent if isinstance(e.parent, str) else ""
        parent = (head or "") if parent == "@head" else parent
        body = e.body if isinstance(e.body, str) else ""
        if e.action == "recover":
            return ("recovered", None, parent) if parent and self.versions.containsKey((parent,)) else ("unknown", None, head)
        if e.action not in ("save", "delete") or (e.action == "delete" and head is None):
            return "conflict" if head is not None and parent != head else "unknown", None, head
        if parent != (head or ""):
            return "conflict", None, head
        before = self.versions.getValue((head,))[0] if head is not None else None
        digest = hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=16).hexdigest()
        if e.action == "delete":
            body, digest = self.bodies.getValue((before,))[0], before
        elif digest == before:
            return "noop", None, head
        made = content_key(note, head or "", body)
        if not self.versions.containsKey((made,)):
            self.versions.updateValue((made,), (digest,))
            self.bodies.updateValue((digest,), (body,))
        return "deleted" if e.action == "delete" else "created" if head is None else "updated", made, made

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head = self.head.get()[0] if self.head.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            outcome, made, head = self._entry(key[0], head, e)
            out.append((key[0], e.seq, e.action, outcome, made, head))
        if head is not None:
            self.head.update((head,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def edit_log(log: DataFrame) -> DataFrame:
    """The replay of operators.state on a stream of (note_id, seq, action, body, parent): what each entry did. Entries of a note
    within a batch are taken in order of ``seq``. Needs the RocksDB state store (see ``keyed_state``)."""
    return log.groupBy("note_id").transformWithStateInPandas(_EditLog(), _OUTCOME, "Append", "None")


def maintain_index(heads: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], tables: KeyedTables, checkpoint: str) -> StreamingQuery:
    """Keeps index tables on disk in step with changed heads (target_version, body): every batch replaces the rows of its
    targets in all tables at once. A target whose body is null or has no rows any more is evicted. A batch that runs again
    after a failure starts over, one that was done changes nothing. Batches are named by the checkpoint and their number."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, number: int) -> None:
        twice = batch.groupBy("target_version").count().filter("count > 1")  # of targets alone: bodies needn't move for it
        latest = batch if twice.isEmpty() else batch.dropDuplicates(["target_version"])
        tables.rebuild(f"{name}-{number}", latest, lambda rows: build(rows.filter("body is not null")))

    return heads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Snapshots(StatefulProcessor):
    """The head of an external as a value, and when each of its bodies was first seen as a map keyed by digest, so state grows by
    an entry for each new body. A timer lets an external go once the watermark is a day past its newest fetch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "digest string, status string, at timestamp, timer long")
        self.seen = handle.getMapState("seen", "digest string", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, status, at, timer = self.head.get() if self.head.exists() else (None, None, None, None)
        newest, out = 0, []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = e.fetched_at.to_pydatetime()
            newest = max(newest, int(e.fetched_at.timestamp() * 1000))
            digest = hashlib.blake2b((e.body or "").encode("utf-8", "replace"), digest_size=16).hexdigest()
            if e.status == "tombstone" and status == "ok" and now <= at:
                outcome = "late"
            elif digest == head:
                outcome, at = "same", max(now, at) if e.status == "ok" else at
            else:
                outcome = "seen" if self.seen.containsKey((digest,)) else "new"
                if outcome == "new":
                    self.seen.updateValue((digest,), (now,))
                head, status, at = digest, e.status, now
            out.append((key[0], e.seq, e.body, e.status, outcome, e.fetched_at))
        due = max(newest, timerValues.getCurrentWatermarkInMs()) + _KEPT_MS
        if timer is None or due > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if head is not None:
            self.head.update((head, status, at, timer))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _INGESTED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.head.clear()
        self.seen.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in _INGESTED.split(", ")])

    def close(self) -> None:
        pass


def ingest_snapshots(fetches: DataFrame, late: str = "1 day") -> DataFrame:
    """(external_id, seq, body, status, outcome, fetched_at) of a stream of fetches (external_id, seq, body, status, fetched_at),
    taken in order of ``seq`` within a batch: new, seen (the head moves back), same, or late (a tombstone not newer than an ok
    head: it changes nothing). Needs the RocksDB state store."""
    return fetches.withWatermark("fetched_at", late).groupBy("external_id").transformWithStateInPandas(_Snapshots(), _INGESTED, "Append", "EventTime")


def dedupe_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests (type, target_version, prompt_ver, ts), each key once within the watermark's delay."""
    return requests.withColumn("prompt_ver", F.coalesce("prompt_ver", F.lit(""))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["type", "target_version", "prompt_ver"])


def redaction_audit(rows: DataFrame, window: str = "1 hour", late: str = "1 hour", patterns: dict[str, str] = SECRETS) -> DataFrame:
    """(window start, pattern, spans) of a stream of (ts, text), counted per event-time window."""
    each = redaction_counts(rows.withWatermark("ts", late), "text", patterns).select("ts", F.explode("counts").alias("pattern", "n"))
    return each.groupBy(F.window("ts", window), "pattern").agg(F.sum("n").alias("spans")).select(F.col("window.start").alias("start"), "pattern", "spans")


def event_counts(rows: DataFrame, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start, by, n) of a stream with ``ts``."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stores maps entry by entry."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads what it wrote; the folder must be one that all executors see."""
    with keyed_state(stream.sparkSession):
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").format("parquet").trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def upserted(stream: DataFrame, by: tuple[str, ...], folder: str) -> DataFrame:
    """Runs a stream of counts in update mode and reads its result: the newest row for each value of ``by``. Each batch replaces
    the rows of its keys, so windows appear with their first row and need not wait for the watermark, and a batch that runs
    again changes nothing."""
    spark = stream.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    tables = KeyedTables(spark, f"{folder}/tables", {"rows": f"_key string, {kinds}"}, "_key")

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_key", F.to_json(F.struct(*by))).persist()  # the batch is read for its keys and its rows
        tables.replace(f"b{number}", rows, rows=rows)
        rows.unpersist()

    stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return tables.read("rows").drop("_key")


__all__ = ["dedupe_requests", "drained", "edit_log", "event_counts", "ingest_snapshots", "keyed_state", "maintain_index", "redaction_audit", "upserted"]
