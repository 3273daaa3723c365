"""Corpus and log statistics (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _heads(externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    return snapshots.join(externals.select(F.col("head_snapshot_id").alias("snapshot_id")), "snapshot_id", "left_semi")


def snapshot_status(externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    return _heads(externals, snapshots).groupBy("status").agg(F.count("*").alias("n"))


def tombstone_reason(body: F.Column) -> F.Column:
    """The reason in a tombstone's body; 'other' where it has another shape."""
    found = F.regexp_extract(body, r"^\[tombstone: (.+)\]$", 1)
    return F.when(found != "", found).otherwise("other")


def tombstone_reasons(externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    return _heads(externals, snapshots).filter("status = 'tombstone'").groupBy(tombstone_reason(F.col("body")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def retained_payloads(externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(n): heads without text that still have their raw payload."""
    return _heads(externals, snapshots).filter((F.col("status") == "tombstone") & (tombstone_reason(F.col("body")) == "empty_extract") & F.col("raw_payload").isNotNull()).agg(F.count("*").alias("n"))


def note_counts(notes: DataFrame, versions: DataFrame) -> DataFrame:
    heads = notes.join(versions.select(F.col("version_id").alias("head_version_id"), "op"), "head_version_id")
    return heads.agg(F.count("*").alias("total"), F.count_if(F.col("op") != "delete").alias("live"), F.count_if(F.col("op") == "delete").alias("deleted"))


def chain_stats(versions: DataFrame) -> DataFrame:
    return versions.groupBy("note_id").agg(F.count("*").alias("depth")).agg(F.sum("depth").alias("versions"), F.max("depth").alias("longest"), F.avg("depth").alias("average"))


def source_types(externals: DataFrame) -> DataFrame:
    return externals.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if("no_egress").alias("no_egress"))


def index_stats(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: passages, vectors, targets with passages, and how many of these have a vector and have none."""
    done = vectors.select("target_version").distinct().withColumn("has", F.lit(1))
    targets = passages.groupBy("target_version").agg(F.count("*").alias("n")).join(done, "target_version", "left")
    counted = targets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("passages"), F.count("*").alias("targets"), F.count("has").alias("embedded"))
    return counted.crossJoin(vectors.agg(F.count("*").alias("vectors"))).select("passages", "vectors", "targets", "embedded", (F.col("targets") - F.col("embedded")).alias("without"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(by, value, n): edges by status and by source, in one pass with grouping sets."""
    rows = edges.groupingSets([["status"], ["source"]], "status", "source").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return rows.select(F.when(F.col("g") == 1, "status").otherwise("source").alias("by"), F.when(F.col("g") == 1, F.col("status")).otherwise(F.col("source")).alias("value"), "n")


def search_log_stats(log: DataFrame) -> DataFrame:
    """One row: invocations, misses (no hit), miss rate."""
    return log.agg(F.count("*").alias("invocations"), F.count_if(F.col("hit_count") == 0).alias("misses"), F.coalesce(F.try_divide(F.count_if(F.col("hit_count") == 0).cast("double"), F.count("*")), F.lit(0.0)).alias("miss_rate"))


def top_misses(log: DataFrame, top: int = 10) -> DataFrame:
    """(query, n): the queries that most often found nothing."""
    return log.filter("hit_count = 0").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(top)


def tool_calls(sessions: DataFrame) -> DataFrame:
    """(session_id, day, role, kind) of each tool call in session rows (session_id, ts, role, calls: array of struct(name,
    input)): a call of the index is 'index', one that reads the files behind it 'direct', any other use 'ambiguous'."""
    each = sessions.select("session_id", F.to_date("ts").alias("day"), "role", F.explode("calls").alias("c"))
    text = F.lower(F.coalesce("c.input", F.lit("")))
    kind = F.when(text.contains("docs_index"), "index").when(F.col("c.name").isin("Read", "Grep", "Glob") & text.contains("docs/"), "direct").when(text.contains("docs"), "ambiguous")
    return each.select("session_id", "day", "role", kind.alias("kind")).filter("kind is not null")


def tool_call_totals(calls: DataFrame) -> DataFrame:
    """(day, role, kind, n) per day, per role and in all (null where summed over)."""
    return calls.groupingSets([["kind"], ["day", "kind"], ["role", "kind"]], "day", "role", "kind").agg(F.count("*").alias("n"))
