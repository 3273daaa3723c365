"""Queries that run the streaming forms over the given tables, read as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import blake2b_key
from ..functions.recovery import fresh_folder
from ..operators import search
from ..operators.text import SECRETS, TOKEN_ASSIGNMENT
from ..sources.mapping import given
from ..streaming import jobs
from .relational import SQL, prelude
from .retrieval import CUT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of them, as a file stream (streams take a single file only by a pattern)."""
    rows = spark.readStream.schema(given(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


# Each conversation is a note: its turns are saves. After them come, by its number, a recovery of its first version, a recovery
# of an unknown one, a deletion, a second one, a save on a stale parent, and a save that brings the text back.
_AFTER = """, after AS (SELECT conv_id, body AS first, (SELECT t.body FROM turns t WHERE t.conv_id = f.conv_id AND t.seq = t.n) AS last FROM turns f WHERE seq = 1),
entries AS (SELECT conv_id, seq, 'save' AS action, CASE WHEN seq = 1 THEN 'created' WHEN body = before THEN 'noop' ELSE 'updated' END AS outcome FROM (SELECT *, lag(body) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM turns)
UNION ALL SELECT conv_id, 1000001, 'recover', 'recovered' FROM after WHERE conv_id % 5 = 0 UNION ALL SELECT conv_id, 1000002, 'recover', 'unknown' FROM after WHERE conv_id % 11 = 0
UNION ALL SELECT conv_id, 1000003, 'delete', 'deleted' FROM after WHERE conv_id % 7 = 0 UNION ALL SELECT conv_id, 1000004, 'save', 'conflict' FROM after WHERE conv_id % 3 = 0
UNION ALL SELECT conv_id, 1000005, 'delete', 'deleted' FROM after WHERE conv_id % 21 = 0
UNION ALL SELECT conv_id, 1000006, 'save', CASE WHEN first = CASE WHEN conv_id % 5 = 0 THEN first ELSE last END THEN 'noop' ELSE 'updated' END FROM after WHERE conv_id % 2 = 0)"""


def _edit_entries(turns: DataFrame) -> DataFrame:
    """(note_id, seq, action, body, parent) of turns (conv_id, turn, text), the first of which has turn 0."""
    note, body = F.concat(F.lit("c"), "conv_id"), F.coalesce("text", F.lit(""))
    saved = F.struct((F.col("turn") + 1).cast("long").alias("seq"), F.lit("save").alias("action"), F.lit("@head").alias("parent"))
    root = blake2b_key(note, F.lit(""), body)
    extra = lambda seq, every, action, parent: F.when((F.col("turn") == 0) & (F.col("conv_id") % every == 0), F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(action).alias("action"), parent.alias("parent")))
    steps = F.array(
        saved, extra(1_000_001, 5, "recover", root), extra(1_000_002, 11, "recover", F.lit("nowhere")), extra(1_000_003, 7, "delete", F.lit("@head")),
        extra(1_000_004, 3, "save", F.lit("stale")), extra(1_000_005, 21, "delete", F.lit("@head")), extra(1_000_006, 2, "save", F.lit("@head")),
    )
    rows = turns.select(note.alias("note_id"), body.alias("body"), F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("e"))
    return rows.select("note_id", "e.seq", "e.action", "body", "e.parent")


@query("l1_edit_log", prelude("turns") + _AFTER + " SELECT concat('c', conv_id) AS note_id, seq, action, outcome FROM entries")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _stream(spark, sf_dir, "conversations").filter("conv_id is not null")
    rows = jobs.drained(jobs.edit_log(_edit_entries(turns)), fresh_folder(spark, "edit-log"))
    return rows.select("note_id", "seq", "action", "outcome")


@query("l2_index_upkeep", prelude("doc_notes") + CUT + " SELECT concat(head_version_id, ':', ord) AS passage_id, char_start, char_end FROM cut JOIN doc_notes USING (doc_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "index")
    heads = _stream(spark, sf_dir, "documents").filter("doc_id is not null").select(F.concat(F.lit("d"), "doc_id", F.lit(".1")).alias("target_version"), F.col("text").alias("body"))
    tables = search.index_folder(spark, f"{folder}/index")
    jobs.maintain_index(heads, search.index_bodies, tables, f"{folder}/state").awaitTermination()
    return search.open_index(tables)[0].select("passage_id", *[F.col(c).cast("long").alias(c) for c in ("char_start", "char_end")])


# Fetches of a site by page number; every third has the page itself as body, others a part of the URL. Of every eight, one is a
# tombstone of now and one a tombstone of long ago, which comes too late where the head is ok.
_FETCHED = """WITH f AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS external_id, page_id, CASE WHEN page_id % 4 = 0 THEN concat('[tombstone: http_', 404 + page_id % 3, ']') WHEN page_id % 3 = 0 THEN coalesce(html, '') ELSE regexp_extract(url, '://[^/]+/([^/]+)', 1) END AS body,
CASE page_id % 8 WHEN 0 THEN 'now' WHEN 4 THEN 'old' ELSE 'ok' END AS kind FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL),
g AS (SELECT *, last_value(CASE WHEN kind <> 'old' THEN kind END IGNORE NULLS) OVER (PARTITION BY external_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head_kind FROM f),
h AS (SELECT *, kind = 'old' AND coalesce(head_kind, '') = 'ok' AS late FROM g),
k AS (SELECT *, lag(body) OVER (PARTITION BY external_id ORDER BY page_id) AS before, min(page_id) OVER (PARTITION BY external_id, body) AS first FROM h WHERE NOT late)"""


@query(
    "l3_snapshots",
    _FETCHED + " SELECT external_id, page_id AS seq, CASE WHEN body = before THEN 'same' WHEN page_id = first THEN 'new' ELSE 'seen' END AS outcome FROM k UNION ALL SELECT external_id, page_id, 'late' FROM h WHERE late",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    rows = _stream(spark, sf_dir, "pages").filter("url is not null and page_id is not null")
    kind = F.col("page_id") % 8
    reason = F.concat(F.lit("[tombstone: http_"), 404 + F.col("page_id") % 3, F.lit("]"))
    body = F.when(F.col("page_id") % 4 == 0, reason).when(F.col("page_id") % 3 == 0, F.coalesce("html", F.lit(""))).otherwise(part("://[^/]+/([^/]+)"))
    fetches = rows.select(
        part("://([^/]+)").alias("external_id"), F.col("page_id").cast("long").alias("seq"), body.alias("body"),
        F.when(kind.isin(0, 4), "tombstone").otherwise("ok").alias("status"), F.timestamp_seconds(F.lit(1706745600) + F.when(kind == 4, F.lit(-1_000_000)).otherwise(F.lit(0)) + F.col("page_id")).alias("fetched_at"),
    )
    return jobs.drained(jobs.ingest_snapshots(fetches), fresh_folder(spark, "snapshots")).select("external_id", "seq", "outcome")


@query("l4_live_requests", "SELECT DISTINCT event_type AS type, concat('t', user_id) AS target_version FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.concat(F.lit("t"), "user_id").alias("target_version"), F.lit(None).cast("string").alias("prompt_ver"), "ts")
    return jobs.drained(jobs.dedupe_requests(rows, "400 days"), fresh_folder(spark, "requests")).select("type", "target_version")


@query("l5_audit_counts", "SELECT date_trunc('hour', ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "events").select("ts", F.col("event_type").alias("type"))
    return jobs.upserted(jobs.event_counts(rows, "type"), ("start", "type"), fresh_folder(spark, "counts"))


@query(
    "l5_redaction_counts",
    """SELECT date_trunc('hour', make_timestamp((1706745600 + doc_id * 60) * 1000000)) AS start, 'token_assignment' AS pattern, CAST(sum(n) AS BIGINT) AS spans
FROM (SELECT doc_id, len(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS n FROM documents WHERE doc_id IS NOT NULL) WHERE n > 0 GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "documents").filter("doc_id is not null").select(F.timestamp_seconds(F.lit(1706745600) + F.col("doc_id") * 60).alias("ts"), "text")
    return jobs.upserted(jobs.redaction_audit(rows, patterns=SECRETS | TOKEN_ASSIGNMENT), ("start", "pattern"), fresh_folder(spark, "redactions"))
