"""Annotations: load, anchors, display, tags, enrichment views, staleness, materiality (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import predecessors

MATERIAL_FROM = 0.2


def load_enrichment(annotations: DataFrame, results: DataFrame) -> DataFrame:
    """The annotations with the AI rows of each result's source version replaced by the result (target, source_version,
    kind, payload, model, provider, quoted_text), less what the user has a row for. No row, no change of others."""
    replaced = results.select("source_version").distinct().withColumn("source", F.lit("ai"))
    kept = annotations.join(replaced, ["source_version", "source"], "left_anti").select(annotations.columns)
    users = annotations.filter("source = 'user'").select("target", "kind", "payload").distinct()
    new = results.join(users, ["target", "kind", "payload"], "left_anti").dropDuplicates(["target", "source_version", "kind", "payload"])
    return kept.unionByName(new.withColumns({"source": F.lit("ai"), "status": F.lit("fresh")}), allowMissingColumns=True)


def enrichment_targets(ids: DataFrame, notes: DataFrame, versions: DataFrame, externals: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((target_version, owner_id, body) to enrich, (target_version, reason) skipped): known, live and free to leave."""
    v = notes.join(versions, "note_id").select(F.col("version_id").alias("target_version"), F.col("note_id").alias("owner_id"), "body", "no_egress", ((F.col("version_id") == F.col("head_version_id")) & (F.col("op") != "delete")).alias("live"))
    s = externals.join(snapshots, "external_id").select(F.col("snapshot_id").alias("target_version"), F.col("external_id").alias("owner_id"), "body", "no_egress", ((F.col("snapshot_id") == F.col("head_snapshot_id")) & (F.col("status") != "tombstone")).alias("live"))
    rows = ids.select("target_version").distinct().join(v.unionByName(s), "target_version", "left")
    reason = F.when(F.col("owner_id").isNull(), "unknown").when(~F.col("live"), "dead").when(F.col("no_egress"), "withheld")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select("target_version", "owner_id", "body"), rows.filter("reason is not null").select("target_version", "reason")


def reanchor(rows: DataFrame, heads: DataFrame, key: str, anchor: str) -> DataFrame:
    """AI rows against the new head body of what they hang on (heads: key, head_version_id, body): quote there: fresh; quote
    gone but anchor there: stale; else orphaned; without a quote fresh or orphaned. Fresh rows move to the head."""
    joined = rows.join(heads.select(key, "head_version_id", "body"), key, "left")
    has = lambda c: F.coalesce(F.contains("body", c), F.lit(False))
    state = F.when(F.col("quoted_text").isNotNull(), F.when(has("quoted_text"), "fresh").when(has(anchor), "stale").otherwise("orphaned")).otherwise(F.when(has(anchor), "fresh").otherwise("orphaned"))
    moves = (F.col("source") == "ai") & F.col("head_version_id").isNotNull()
    out = joined.withColumn("status", F.when(moves, state).otherwise(F.col("status")))
    return out.withColumn("source_version", F.when(moves & (F.col("status") == "fresh"), F.col("head_version_id")).otherwise(F.col("source_version"))).select(rows.columns)


def suppress(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed ids become the user's orphaned rows without a source version, which keep the value from coming back."""
    hit = listed.select("id").distinct().withColumn("_hit", F.lit(True))
    rows2 = rows.join(hit, "id", "left")
    done = F.col("_hit").isNotNull()
    changes = {"source": F.when(done, F.lit("user")).otherwise(F.col("source")), "status": F.when(done, F.lit("orphaned")).otherwise(F.col("status")), "source_version": F.when(~done, F.col("source_version"))}
    return rows2.withColumns({c: v for c, v in changes.items() if c in rows.columns}).select(rows.columns)


def displayed(rows: DataFrame) -> DataFrame:
    """The visible rows with a ``stale`` flag: what the user removed is hidden, and action items that aren't fresh."""
    hidden = (F.col("source") == "user") & (F.col("status") == "orphaned")
    if "kind" in rows.columns:
        hidden = hidden | ((F.col("kind") == "action_item") & (F.col("status") != "fresh"))
    return rows.filter(~hidden).withColumn("stale", F.col("status") != "fresh")


def display_counts(annotations: DataFrame) -> DataFrame:
    return displayed(annotations).groupBy("target", "kind").agg(F.count("*").alias("visible"), F.count_if("stale").alias("stale"))


def tags(annotations: DataFrame) -> DataFrame:
    """(payload): the visible tags, each once."""
    return displayed(annotations).filter("kind = 'tag' and payload is not null").select("payload").distinct()


def _tags_of(annotations: DataFrame) -> DataFrame:
    return displayed(annotations).filter("kind = 'tag' and payload is not null").select("target", "payload", "stale", "id")


def notes_with_all_tags(notes: DataFrame, annotations: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(note_id): notes that have every asked tag, of their own or of something that a fresh edge links them to."""
    asked = asked.select("payload").distinct()
    own = _tags_of(annotations).select(F.col("target").alias("note_id"), "payload")
    linked = edges.filter("status = 'fresh'").select(F.col("from_id").alias("note_id"), F.col("to_id").alias("target")).distinct().join(_tags_of(annotations), "target").select("note_id", "payload")
    matched = own.unionByName(linked).join(asked, "payload", "left_semi").groupBy("note_id").agg(F.count_distinct("payload").alias("n"))
    return matched.join(F.broadcast(asked.agg(F.count("*").alias("n"))), "n").join(notes, "note_id", "left_semi").select("note_id")


def inherited_tags(annotations: DataFrame, edges: DataFrame) -> DataFrame:
    """(note_id, payload, stale): tags of what fresh edges link a note to, without its own; a fresh one first, else the
    first."""
    found = edges.filter("status = 'fresh'").select(F.col("from_id").alias("note_id"), F.col("to_id").alias("target")).distinct().join(_tags_of(annotations), "target")
    own = _tags_of(annotations).select(F.col("target").alias("note_id"), "payload").distinct()
    rest = found.join(own, ["note_id", "payload"], "left_anti")
    return rest.groupBy("note_id", "payload").agg(F.min("stale").alias("stale"))


_STATES = ("withheld", "stale_externals", "un_refreshed")


def enrichment_view(notes: DataFrame, annotations: DataFrame, edges: DataFrame, jobs: DataFrame, passages: DataFrame, vectors: DataFrame, externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row per note (note_id, head_version_id): summary, tags, entities, links, state, passages, embedded; of its links to
    externals, how many are withheld (may not leave), stale (the head is a tombstone) or un-refreshed (the head may have
    changed since it was fetched)."""
    shown = displayed(annotations).filter("payload is not null").groupBy(F.col("target").alias("note_id")).agg(
        F.min_by("payload", F.when(F.col("kind") == "summary", F.struct("stale", "id"))).alias("summary"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "tag", F.col("payload")))).alias("tags"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "entity", F.col("payload")))).alias("entities"),
    )
    links = displayed(edges).groupBy(F.col("from_id").alias("note_id")).agg(F.count("*").alias("links"), F.count_if("stale").alias("stale_links"))
    heads = externals.join(snapshots.select(F.col("snapshot_id").alias("head_snapshot_id"), "status"), "head_snapshot_id")
    is_in = F.when(F.col("no_egress"), "withheld").when(F.col("status") == "tombstone", "stale_externals").otherwise("un_refreshed")
    heads = heads.select(F.col("external_id").alias("to_id"), is_in.alias("is_in"))
    outside = displayed(edges).select(F.col("from_id").alias("note_id"), "to_id").join(heads, "to_id").groupBy("note_id").agg(*[F.count_if(F.col("is_in") == c).alias(c) for c in _STATES])
    work = jobs.filter("type = 'enrich'").groupBy(F.col("target_version").alias("head_version_id")).agg(F.bool_or(F.col("status").isin("pending", "running")).alias("pending"), F.bool_or(F.col("status").isin("failed", "dead")).alias("failed"))
    has_ai = annotations.filter("source = 'ai'").select(F.col("source_version").alias("head_version_id"), F.lit(True).alias("has_ai")).distinct()
    cut = passages.groupBy(F.col("target_version").alias("head_version_id")).agg(F.count("*").alias("passages"))
    done = vectors.select(F.col("target_version").alias("head_version_id"), F.lit(True).alias("embedded")).distinct()
    rows = notes.select("note_id", "head_version_id").join(shown, "note_id", "left").join(links, "note_id", "left").join(outside, "note_id", "left")
    for part in (work, has_ai, cut, done):
        rows = rows.join(part, "head_version_id", "left")
    state = F.when(F.col("has_ai"), "ready").when(F.col("pending"), "pending").when(F.col("failed"), "failed").otherwise("pending")
    none = F.array().cast("array<string>")
    return rows.select("note_id", "summary", F.coalesce("tags", none).alias("tags"), F.coalesce("entities", none).alias("entities"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("links", "stale_links", "passages", *_STATES)], state.alias("state"), F.coalesce("embedded", F.lit(False)).alias("embedded"))


def stale_heads(heads: DataFrame, annotations: DataFrame, jobs: DataFrame, model: str, provider: str | None) -> DataFrame:
    """(target_version): heads (target_version, no_egress) free to leave, with an AI annotation by another model or
    provider (null is a value of its own), without a standing refusal of the current model."""
    other = (F.col("source") == "ai") & ((F.col("model") != model) | ~F.col("provider").eqNullSafe(F.lit(provider)))
    old = annotations.filter(other).select(F.col("source_version").alias("target_version"))
    refused = jobs.filter(F.col("type").eqNullSafe("enrich") & F.col("refusal") & (F.col("refusal_model") == model) & F.col("refusal_provider").eqNullSafe(F.lit(provider))).select("target_version")
    return heads.filter(~F.col("no_egress")).select("target_version").distinct().join(old, "target_version", "left_semi").join(refused, "target_version", "left_anti")


def material(snapshots: DataFrame, vectors: DataFrame, threshold: float = MATERIAL_FROM) -> DataFrame:
    """(snapshot_id, delta, reenrich): one minus the cosine of the mean vectors of a snapshot and its predecessor; a zero
    vector has similarity 0; no predecessor or no vectors: enrich again."""
    means = vectors.select("target_version", F.posexplode("vector").alias("i", "x")).groupBy("target_version", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    size = means.groupBy("target_version").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    pairs = predecessors(snapshots)
    a = pairs.join(means.withColumnRenamed("target_version", "snapshot_id").withColumnRenamed("x", "a"), "snapshot_id")
    dots = a.join(means.select(F.col("target_version").alias("predecessor_id"), "i", F.col("x").alias("b")), ["predecessor_id", "i"]).groupBy("snapshot_id", "predecessor_id").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    sized = dots.join(size.select(F.col("target_version").alias("snapshot_id"), F.col("size").alias("n")), "snapshot_id").join(size.select(F.col("target_version").alias("predecessor_id"), F.col("size").alias("m")), "predecessor_id")
    delta = 1 - F.when((F.col("n") == 0) | (F.col("m") == 0), F.lit(0.0)).otherwise(F.col("dot") / (F.col("n") * F.col("m")))
    rows = snapshots.select("snapshot_id").join(sized.select("snapshot_id", delta.alias("delta")), "snapshot_id", "left")
    return rows.select("snapshot_id", "delta", (F.col("delta").isNull() | (F.round("delta", 12) >= threshold)).alias("reenrich"))
