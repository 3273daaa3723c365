"""Version chains, heads and snapshots (B)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import content_key
from ..functions.recovery import checkpointed, numbered
from ..sources.keyed import KeyedTables
from . import search

PREFIX_PASSES = 36
PURGED = "[purged]"


def live_heads(notes: DataFrame, versions: DataFrame, externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(target_version): head versions that aren't deletions, and head snapshots that aren't tombstones."""
    a = notes.join(versions.filter("op <> 'delete'"), F.col("head_version_id") == F.col("version_id")).select(F.col("version_id").alias("target_version"))
    b = externals.join(snapshots.filter("status <> 'tombstone'"), F.col("head_snapshot_id") == F.col("snapshot_id")).select(F.col("snapshot_id").alias("target_version"))
    return a.unionByName(b).distinct()


def first_line(body: Column) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def _with_heads(notes: DataFrame, versions: DataFrame) -> DataFrame:
    chain = versions.groupBy("note_id").agg(F.count("*").alias("versions"))
    head = versions.select(F.col("version_id").alias("head_version_id"), "body", "op")
    return notes.join(head, "head_version_id").join(chain, "note_id")


def list_notes(notes: DataFrame, versions: DataFrame, annotations: DataFrame) -> DataFrame:
    """(note_id, position, versions, summary) of live notes, the last inserted first. The summary is the first fresh AI
    summary of just the head version, else the body's first line."""
    summaries = annotations.filter("kind = 'summary' and source = 'ai' and status = 'fresh'").groupBy(F.col("source_version").alias("head_version_id")).agg(F.min_by("payload", "id").alias("ai"))
    rows = _with_heads(notes, versions).filter("op <> 'delete'").join(summaries, "head_version_id", "left")
    rows = rows.select("note_id", "inserted", "versions", F.coalesce("ai", first_line(F.col("body"))).alias("summary"))
    return numbered(rows, F.desc("inserted")).drop("inserted")


def list_deleted_notes(notes: DataFrame, versions: DataFrame) -> DataFrame:
    """(note_id, versions, summary) of notes whose head is a deletion; the summary is the first line."""
    return _with_heads(notes, versions).filter("op = 'delete'").select("note_id", "versions", first_line(F.col("body")).alias("summary"))


def history(notes: DataFrame, versions: DataFrame) -> DataFrame:
    """(note_id, version_id, seq): each head's chain by parent pointers, 1 at the root. Branches that no head reaches are
    left out. Chains are walked by doubling: each round joins pointers of twice the length, so rounds grow with the
    logarithm of the longest chain. Pointers that run in a circle are an error."""
    up = versions.select("version_id", F.col("parent_version_id").alias("ancestor"), F.lit(1).cast("long").alias("steps"))
    reached = notes.select("note_id", F.col("head_version_id").alias("version_id"), F.lit(0).cast("long").alias("back")).join(versions.select("version_id"), "version_id", "left_semi")
    total, length = versions.count(), 1
    while True:
        if length > 2 * total:
            raise ValueError("parent pointers run in a circle")
        reached = checkpointed(reached.unionByName(reached.join(up.filter("ancestor is not null"), "version_id").select("note_id", F.col("ancestor").alias("version_id"), (F.col("back") + F.col("steps")).alias("back"))))
        after = up.select(F.col("version_id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more"))
        longer = checkpointed(up.filter("ancestor is not null").join(after, "ancestor").select("version_id", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps")).filter("ancestor is not null"))
        if longer.isEmpty():
            break
        up, length = longer, length * 2
    depth = reached.groupBy("note_id").agg(F.max("back").alias("last"))
    return reached.join(depth, "note_id").select("note_id", "version_id", (F.col("last") - F.col("back") + 1).alias("seq"))


class _Chain:
    """A note's head, its versions (id -> digest of the body) and their bodies, equal ones once."""

    def __init__(self) -> None:
        self.head: str | None = None
        self.digests: dict[str, bytes] = {}
        self.bodies: dict[bytes, str] = {}

    def apply(self, note: str, action: str, body: str, parent: str) -> tuple[str, str | None, str | None]:
        """(outcome, id, op) of an entry; op is null where no row is made."""
        head = self.head
        parent = (head or "") if parent == "@head" else parent
        if action == "recover":
            if parent not in self.digests:
                return "unknown", None, None
            self.head = parent
            return "recovered", None, None
        if head is None and action != "save":
            return "unknown", None, None
        if parent != (head or ""):
            return "conflict", None, None
        if action not in ("save", "delete"):
            return "unknown", None, None
        digest = self.digests[head] if action == "delete" else hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=16).digest()
        if action == "save" and head is not None and digest == self.digests[head]:
            return "noop", None, None
        made = content_key(note, head or "", self.bodies[digest] if action == "delete" else body)
        fresh = made not in self.digests
        if fresh:
            self.digests[made] = digest
            self.bodies.setdefault(digest, body)
        self.head = made
        op = "delete" if action == "delete" else "create" if head is None else "update"
        return {"delete": "deleted", "create": "created", "update": "updated"}[op], made, op if fresh else None


def replay(log: DataFrame) -> DataFrame:
    """Replays an edit log (note_id, seq, action, body, parent) into (note_id, seq, action, outcome, version_id, head_id,
    op): what each entry did.

    ``parent`` is a version id, '' for a root, or '@head' for the head at that point. Outcomes: created, updated, noop,
    deleted, recovered, conflict, unknown. Each id depends on the one before, so a note's entries are taken in turn; they
    stream through in the order of the sort, and of a note only its ids and different bodies are held, never its entries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        note, chain = None, _Chain()
        for batch in batches:
            out = []
            for e in batch.itertuples():
                if e.note_id != note:
                    note, chain = e.note_id, _Chain()
                outcome, made, op = chain.apply(note or "", e.action, e.body or "", e.parent or "")
                out.append((note, e.seq, e.action, outcome, made, chain.head, op))
            yield pd.DataFrame(out, columns=["note_id", "seq", "action", "outcome", "version_id", "head_id", "op"])

    rows = log.select("note_id", F.col("seq").cast("long").alias("seq"), "action", "body", "parent").repartition("note_id").sortWithinPartitions("note_id", "seq")
    return rows.mapInPandas(run, "note_id string, seq long, action string, outcome string, version_id string, head_id string, op string")


def without_noops(log: DataFrame) -> DataFrame:
    """A log without conflicts: drops saves that repeat the body before them; native, by a window per note."""
    before = F.lag("body").over(Window.partitionBy("note_id").orderBy("seq"))
    return log.withColumn("_before", before).filter(~F.col("body").eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def purge(versions: DataFrame, annotations: DataFrame, passages: DataFrame, listed: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Overwrites the whole chains of the listed notes with a marker, drops their AI annotations and index rows. ``touched`` are
    the versions whose rows an index on disk must replace, see purge_index."""
    hit = versions.join(listed.select("note_id").distinct(), "note_id", "left_semi").select("version_id")
    marked = versions.join(hit.withColumn("_hit", F.lit(True)), "version_id", "left")
    done = F.col("_hit").isNotNull()
    return {
        "versions": marked.withColumns({"body": F.when(done, F.lit(PURGED)).otherwise(F.col("body")), "purged_at": F.when(done, at).otherwise(F.col("purged_at"))}).drop("_hit"),
        "annotations": annotations.join(hit.withColumnRenamed("version_id", "source_version").withColumn("source", F.lit("ai")), ["source_version", "source"], "left_anti").select(annotations.columns),
        "passages": passages.join(hit.withColumnRenamed("version_id", "target_version"), "target_version", "left_anti"),
        "touched": hit.withColumnRenamed("version_id", "target_version"),
    }


def purge_index(tables: KeyedTables, batch: str, purged: dict[str, DataFrame], live: DataFrame) -> bool:
    """Takes the purged versions out of an index on disk as one step; live heads (target_version) among them are indexed anew with
    the marker that they hold now. False if this batch has been done before."""
    touched = purged["touched"]
    marked = purged["versions"].select(F.col("version_id").alias("target_version"), "body").join(touched, "target_version", "left_semi").join(live, "target_version", "left_semi")
    return tables.replace(batch, touched, **search.index_bodies(marked))


def resolve_prefixes(prefixes: DataFrame, notes: DataFrame, versions: DataFrame, include_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """((prefix, outcome, candidates, note_id), (prefix, note_id, created, summary, deleted)): what each prefix is, unique,
    ambiguous or missing, with the smallest id that it begins; and the candidates, a row each.

    An empty prefix is missing; one of 36 characters or more is taken as it is. Prefix search is an equality join for each
    prefix length that occurs.
    """
    heads = versions.select(F.col("version_id").alias("head_version_id"), (F.col("op") == "delete").alias("deleted"), first_line(F.col("body")).alias("summary"))
    live = notes.select("note_id", "head_version_id", "created").join(heads, "head_version_id").drop("head_version_id")
    live = live if include_deleted else live.filter("not deleted")
    asked = prefixes.select("prefix").distinct().withColumn("len", F.length("prefix"))
    lengths = [r[0] for r in asked.filter(F.col("len").between(1, PREFIX_PASSES - 1)).select("len").distinct().collect()]  # at most 35 numbers
    keyed = live.withColumn("len", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).filter(F.length("note_id") >= F.col("len"))
    found = keyed.withColumn("prefix", F.substring(F.col("note_id"), F.lit(1), F.col("len"))).join(asked, ["prefix", "len"]).select("prefix", "note_id", "created", "summary", "deleted")
    counts = found.groupBy("prefix").agg(F.count("*").alias("candidates"), F.min("note_id").alias("note_id"))
    whole = asked.filter(F.col("len") >= PREFIX_PASSES).select("prefix", F.lit(1).cast("long").alias("candidates"), F.col("prefix").alias("note_id"))
    out = asked.select("prefix").join(counts.unionByName(whole), "prefix", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.select("prefix", F.when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "unique").otherwise("ambiguous").alias("outcome"), "candidates", "note_id"), found


def ingest(fetches: DataFrame) -> DataFrame:
    """Replays fetches (external_id, order, body, status, fetched_at) into snapshots: (external_id, body, status,
    first_order, fetched_at, is_head).

    The same body as the head is no new row: an ok one moves the row's fetched_at. A body seen before but not head moves the
    head back and keeps the row's time. A run of equal bodies is found with one window per external; rows and head with a
    group each.
    """
    w = Window.partitionBy("external_id").orderBy("order")
    runs = fetches.withColumn("before", F.lag("body").over(w)).withColumn("starts", (F.col("before").isNull() | (F.col("body") != F.col("before"))).cast("int"))
    runs = runs.withColumn("first_seen", F.min("order").over(Window.partitionBy("external_id", "body")))
    # a repeat within a run moves the time of the body's row; the start of a later run doesn't
    moves = (F.col("starts") == 0) & (F.col("status") == "ok")
    rows = runs.groupBy("external_id", "body").agg(
        F.min("order").alias("first_order"), F.min_by("status", "order").alias("status"),
        F.max_by("fetched_at", F.when(moves | (F.col("order") == F.col("first_seen")), F.col("order"))).alias("fetched_at"), F.max("order").alias("last"),
    )
    latest = rows.groupBy("external_id").agg(F.max("last").alias("head_at"))
    return rows.join(latest, "external_id").select("external_id", "body", "status", "first_order", "fetched_at", (F.col("last") == F.col("head_at")).alias("is_head"))


def predecessors(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, predecessor_id): of each snapshot, the latest other one of its external, by fetched_at and order of
    insertion; it may be later than the snapshot itself. Only the two latest of an external can be it."""
    late = F.row_number().over(Window.partitionBy("external_id").orderBy(F.desc("fetched_at"), F.desc("inserted")))
    top = snapshots.select("external_id", F.col("snapshot_id").alias("other"), late.alias("r")).filter("r <= 2")
    pair = top.groupBy("external_id").agg(F.max(F.when(F.col("r") == 1, F.col("other"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("other"))).alias("b"))
    joined = snapshots.select("external_id", "snapshot_id").join(pair, "external_id")
    return joined.select("snapshot_id", F.when(F.col("snapshot_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("predecessor_id")).filter("predecessor_id is not null")


def set_flags(rows: DataFrame, key: str, listed: DataFrame, value: bool) -> tuple[DataFrame, DataFrame]:
    """Sets no_egress on the listed rows; (the table, which of the listed keys matched)."""
    asked = listed.select(key).distinct()
    updated = rows.join(asked.withColumn("_hit", F.lit(value)), key, "left").withColumn("no_egress", F.coalesce("_hit", "no_egress")).drop("_hit")
    return updated, asked.join(rows.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").select(key, F.col("_there").isNotNull().alias("matched"))
