"""Coverage gaps, request ledger (I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFRESH_AFTER_S = 3600
LIVE = ("pending", "running", "failed")


def embedding_gap(heads: DataFrame, jobs: DataFrame) -> DataFrame:
    """(target_version): live heads (target_version, purged) that aren't purged and have no embed request but dead ones."""
    there = jobs.filter("type = 'embed' and status <> 'dead'").select("target_version")
    return heads.filter(~F.col("purged")).select("target_version").distinct().join(there, "target_version", "left_anti")


def _refused(jobs: DataFrame, model: str, provider: str | None) -> DataFrame:
    return jobs.filter((F.col("type") == "enrich") & F.col("refusal") & (F.col("refusal_model") == model) & F.col("refusal_provider").eqNullSafe(F.lit(provider)))


def enrichment_gap(notes: DataFrame, externals: DataFrame, jobs: DataFrame, prompt: str, model: str, provider: str | None = None) -> DataFrame:
    """(target_version) to enrich. notes (target_version, no_egress): free to leave, no live request, none done with this
    prompt, no standing refusal. externals (target_version, external_id, no_egress, scoped): free and out of scope of rules,
    by the latest enrich request of any snapshot (job target_version to external_id by their snapshots)."""
    mine = jobs.filter("type = 'enrich'")
    busy = mine.filter(F.col("status").isin(*LIVE) | ((F.col("status") == "done") & F.col("prompt_ver").eqNullSafe(F.lit(prompt)))).select("target_version")
    own = notes.filter(~F.col("no_egress")).select("target_version").distinct().join(busy.unionByName(_refused(jobs, model, provider).select("target_version")), "target_version", "left_anti")
    free = externals.filter(~F.col("no_egress") & ~F.col("scoped"))
    of = mine.join(free.select("external_id", "snapshot_id"), F.col("target_version") == F.col("snapshot_id")).groupBy("external_id").agg(F.max_by(F.struct("status", "prompt_ver", "refusal", "refusal_model", "refusal_provider"), "id").alias("j"))
    closed = F.col("j.status").isin(*LIVE) | ((F.col("j.status") == "done") & F.col("j.prompt_ver").eqNullSafe(F.lit(prompt))) | (F.col("j.refusal") & (F.col("j.refusal_model") == model) & F.col("j.refusal_provider").eqNullSafe(F.lit(provider)))
    other = free.select("external_id", "target_version").distinct().join(of.filter(closed).select("external_id"), "external_id", "left_anti").select("target_version")
    return own.unionByName(other)


def refresh_due(externals: DataFrame, snapshots: DataFrame, jobs: DataFrame, now: Column, after_s: int = REFRESH_AFTER_S) -> DataFrame:
    """(external_id): externals whose ok head is at least so old, without a live refresh request."""
    old = snapshots.filter((F.col("status") == "ok") & (F.col("fetched_at") <= now - F.make_dt_interval(secs=F.lit(after_s)))).select(F.col("snapshot_id").alias("head_snapshot_id"))
    asked = jobs.filter((F.col("type") == "refresh") & F.col("status").isin(*LIVE)).select(F.col("target_version").alias("external_id"))
    return externals.join(old, "head_snapshot_id", "left_semi").select("external_id").join(asked, "external_id", "left_anti")


def lexical_gap(note_heads: DataFrame, passages: DataFrame) -> DataFrame:
    """(target_version): live note heads without passages."""
    return note_heads.select("target_version").distinct().join(passages.select("target_version"), "target_version", "left_anti")


def append_requests(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests (type, target_version, prompt_ver) to add: each once, none that has a live row with its key."""
    key = ["type", "target_version", "_p"]
    new = requests.withColumn("_p", F.coalesce("prompt_ver", F.lit(""))).dropDuplicates(key)
    live = ledger.filter(F.col("status").isin(*LIVE)).withColumn("_p", F.coalesce("prompt_ver", F.lit(""))).select(key)
    return new.join(live, key, "left_anti").drop("_p")


def compact(ledger: DataFrame) -> DataFrame:
    """The ledger without failed rows that a pending or running row of the same key, or a newer failed one, replaces."""
    key = ["type", "target_version", F.coalesce("prompt_ver", F.lit(""))]
    live = F.col("status").isin("pending", "running")
    w = Window.partitionBy(*key)
    marked = ledger.withColumn("_twin", F.max(live.cast("int")).over(w)).withColumn("_last", F.max(F.when(F.col("status") == "failed", F.col("id"))).over(w))
    drop = (F.col("status") == "failed") & ((F.col("_twin") == 1) | (F.col("id") != F.col("_last")))
    return marked.filter(~drop).drop("_twin", "_last")


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"))


def dead_letters(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'dead'").select("id", "type", "target_version", "refusal")


def refusals(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'dead' and refusal").select("id", "type", "target_version", "refusal_model", "refusal_provider")


def outstanding(ledger: DataFrame) -> DataFrame:
    """(type, n): requests that are still to be done."""
    return ledger.filter(F.col("status").isin(*LIVE)).groupBy("type").agg(F.count("*").alias("n"))
