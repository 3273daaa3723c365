"""Links: extraction, canonical sources, edges (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def extract_urls(bodies: DataFrame, id: str) -> DataFrame:
    """(id, url, position): the distinct URLs of each body, position 1 for the one seen first."""
    spans = bodies.select(id, F.explode(urls.url_spans(F.col("body"))).alias("s"))
    first = spans.groupBy(id, F.col("s.found").alias("url")).agg(F.min("s.start").alias("at"))
    ordered = first.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("at", "url"))).alias("all"))
    return ordered.select(id, F.posexplode("all").alias("p", "u")).select(id, F.col("u.url").alias("url"), (F.col("p") + 1).cast("long").alias("position"))


def canonical_sources(links: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """((external_id, variants, links) per canonical URL, rejected URLs)."""
    named = links.withColumn("external_id", urls.canonical(F.col(url)))
    good = named.filter("external_id is not null").groupBy("external_id").agg(F.count_distinct(url).alias("variants"), F.count("*").alias("links"))
    return good, named.filter(F.col("external_id").isNull() & F.col(url).isNotNull()).select(url).distinct()


def classify_sources(links: DataFrame, sites: dict[str, str] | None = None) -> DataFrame:
    """Adds source_type, external_id and api_base: issue and wiki links on the given sites (see urls.source_class) get their
    key, all others their canonical URL."""
    kind = urls.source_class(F.col("url"), sites)
    return links.select(*links.columns, kind["source_type"].alias("source_type"), F.coalesce(kind["key"], urls.canonical(F.col("url"))).alias("external_id"), kind["api_base"].alias("api_base"))


def bare_keys(bodies: DataFrame, id: str, projects: tuple[str, ...]) -> DataFrame:
    """(id, key, start): issue keys that stand alone and overlap no URL."""
    rows = bodies.select(id, urls.key_spans(F.col("body"), projects).alias("keys"), urls.url_spans(F.col("body")).alias("links"))
    free = F.filter("keys", lambda k: ~F.exists("links", lambda u: (k["start"] < u["end"]) & (k["end"] > u["start"])))
    return rows.select(id, F.explode(free).alias("k")).select(id, F.col("k.found").alias("key"), F.col("k.start").alias("start"))


def build_edges(links: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New user edges, one per (note, external) with the text of the first link, existing ones left as they are; and a
    refresh request for each external with a new edge. ``links``: note_id, external_id, url, position."""
    first = links.groupBy("note_id", "external_id").agg(F.min_by("url", "position").alias("quoted_text"))
    there = existing.filter("source = 'user'").select(F.col("from_id").alias("note_id"), F.col("to_id").alias("external_id")).distinct()
    new = first.join(there, ["note_id", "external_id"], "left_anti")
    edges = new.select(F.col("note_id").alias("from_id"), F.col("external_id").alias("to_id"), F.lit("user").alias("source"), F.lit(1.0).alias("confidence"), "quoted_text", F.lit("fresh").alias("status"))
    return edges, edges.select(F.lit("refresh").alias("type"), F.col("to_id").alias("target_version")).distinct()


def repoint(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges of the user with to_id replaced by the moved table (old_id, new_id)."""
    target = moved.groupBy(F.col("old_id").alias("to_id")).agg(F.max("new_id").alias("new_id"))
    joined = edges.join(target, "to_id", "left")
    return joined.withColumn("to_id", F.when(F.col("source") == "user", F.coalesce("new_id", "to_id")).otherwise(F.col("to_id"))).select(edges.columns)


def backfill(
    edges: DataFrame, externals: DataFrame, snapshots: DataFrame, retry_tombstoned: bool = False, sites: dict[str, str] | None = None, live: DataFrame | None = None, projects: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """Classifies the user's links again from their quoted text, and looks for bare keys in the bodies of live notes
    (``live``: note_id, body) that no link of the note leads to yet.

    mint: externals to add; repoint: edges to move; link: edges to add (note_id, external_id, quoted_text); refresh: externals
    to fetch, being without a head, or with one that is no tombstone unless those are tried again. counts: a row with the
    number of each, which is all that a dry run shows.
    """
    links = edges.filter("source = 'user' and quoted_text is not null").select("id", "to_id", F.col("quoted_text").alias("url"))
    named = classify_sources(links, sites).filter("external_id is not null").select("id", "to_id", "external_id", "source_type", "api_base")
    keys = edges.sparkSession.createDataFrame([], "note_id string, external_id string") if live is None else bare_keys(live, "note_id", projects).groupBy("note_id", F.col("key").alias("external_id")).agg(F.min("start").alias("at")).drop("at")
    there = edges.filter("source = 'user'").join(named.select("id", F.col("external_id").alias("moved")), "id", "left").select(F.col("from_id").alias("note_id"), F.explode(F.array("to_id", F.coalesce("moved", "to_id"))).alias("external_id")) if "from_id" in edges.columns else None
    new = keys if there is None else keys.join(there.distinct(), ["note_id", "external_id"], "left_anti")
    base = F.lit((sites or {}).get("jira", "").rstrip("/") or None).cast("string")
    wanted = named.select("external_id", "source_type", "api_base").unionByName(new.select("external_id", F.lit("jira").alias("source_type"), base.alias("api_base")))
    wanted = wanted.groupBy("external_id").agg(F.min("source_type").alias("source_type"), F.min("api_base").alias("api_base"))
    heads = externals.join(snapshots.select(F.col("snapshot_id").alias("head_snapshot_id"), "status"), "head_snapshot_id", "left").select("external_id", F.col("status").alias("head_status"))
    due = F.col("head_status").isNull() | (F.col("head_status") != "tombstone") | F.lit(retry_tombstoned)
    out = {
        "mint": wanted.join(externals.select("external_id"), "external_id", "left_anti").select("external_id", "source_type", "api_base"),
        "repoint": named.filter(F.col("external_id") != F.col("to_id")).select("id", "to_id", "external_id"),
        "link": new.select("note_id", "external_id", F.col("external_id").alias("quoted_text")),
        "refresh": wanted.select("external_id").join(heads, "external_id", "left").filter(due).select("external_id"),
    }
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in out.items()]
    return out | {"counts": each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])}
