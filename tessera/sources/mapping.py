"""The logical tables of the engine, mapped onto the given tables.

Each mapping is SQL that Spark and DuckDB both run; {ts} turns epoch seconds into a timestamp. ``logical`` reads one in
Spark; ``prelude`` gives the same tables as common table expressions for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> (given or logical tables that it reads, SQL)
MAPPINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "turns": (
        ("conversations",),
        """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, count(*) OVER (PARTITION BY conv_id) AS n,
                  coalesce(text, '') AS body, role FROM conversations WHERE conv_id IS NOT NULL""",
    ),
    "versions": (
        ("turns",),
        """SELECT concat('c', conv_id, '.', seq) AS version_id, concat('c', conv_id) AS note_id,
                  CASE WHEN seq > 1 THEN concat('c', conv_id, '.', seq - 1) END AS parent_version_id, body,
                  CASE WHEN seq = 1 THEN 'create' WHEN seq = n AND conv_id % 7 = 0 THEN 'delete' ELSE 'update' END AS op,
                  CASE WHEN conv_id % 11 = 0 THEN {ts}(1706745600) END AS purged_at, {ts}(1704067200 + conv_id * 60 + seq) AS created FROM turns""",
    ),
    "notes": (
        ("turns",),
        """SELECT concat('c', conv_id) AS note_id, concat('c', conv_id, '.', CASE WHEN conv_id % 14 = 0 AND n > 1 THEN n - 1 ELSE n END) AS head_version_id,
                  conv_id % 5 = 0 AS no_egress, {ts}(1704067200 + conv_id * 60) AS created, conv_id AS inserted FROM turns WHERE seq = 1""",
    ),
    "snapshots": (
        ("pages",),
        """SELECT concat('x', page_id, '.', k) AS snapshot_id, concat('x', page_id) AS external_id,
                  CASE WHEN page_id % 13 = 0 THEN '[tombstone: http_404]' WHEN page_id % 17 = 0 THEN '[tombstone: empty_extract]' WHEN page_id % 19 = 0 THEN 'gone'
                       WHEN k = 2 THEN concat(coalesce(html, ''), ' again') ELSE coalesce(html, '') END AS body,
                  CASE WHEN page_id % 34 <> 0 THEN html END AS raw_payload,
                  CASE WHEN page_id % 13 = 0 OR page_id % 17 = 0 OR page_id % 19 = 0 THEN 'tombstone' ELSE 'ok' END AS status,
                  {ts}(1706745600 + page_id * 60 + k * 86400) AS fetched_at, page_id * 2 + k AS inserted
           FROM pages, (SELECT 1 AS k UNION ALL SELECT 2 AS k) AS f WHERE page_id IS NOT NULL AND (k = 1 OR page_id % 5 = 0)""",
    ),
    "externals": (
        ("pages",),
        """SELECT concat('x', page_id) AS external_id, CASE page_id % 10 WHEN 3 THEN 'jira' WHEN 6 THEN 'confluence' ELSE 'web' END AS source_type,
                  concat('x', page_id, '.', CASE WHEN page_id % 5 = 0 AND page_id % 15 <> 0 THEN 2 ELSE 1 END) AS head_snapshot_id, page_id % 9 = 0 AS no_egress,
                  url, {ts}(1706745600 + page_id * 60) AS created FROM pages WHERE page_id IS NOT NULL""",
    ),
    "doc_notes": (
        ("documents", "labels"),
        """SELECT concat('d', d.doc_id) AS note_id, concat('d', d.doc_id, '.1') AS head_version_id, coalesce(l.toxic, 0) = 1 AS no_egress, coalesce(d.text, '') AS body, d.doc_id
           FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL""",
    ),
    # doc_notes without the flag of the labels: nothing is joined, so no body moves.
    "doc_bodies": (("documents",), "SELECT concat('d', doc_id) AS note_id, concat('d', doc_id, '.1') AS head_version_id, coalesce(text, '') AS body, doc_id FROM documents WHERE doc_id IS NOT NULL"),
    "annotations": (
        ("documents", "labels"),
        """SELECT d.doc_id * 2 + k AS id, concat('d', d.doc_id) AS target, CASE WHEN l.doc_id % 13 = 0 THEN NULL ELSE concat('d', d.doc_id, '.1') END AS source_version,
                  CASE WHEN k = 0 THEN 'tag' ELSE CASE d.doc_id % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'summary' WHEN 2 THEN 'action_item' ELSE 'tag' END END AS kind,
                  CASE WHEN k = 0 THEN d.lang ELSE d.source END AS payload, CASE WHEN l.quality = 1 THEN 'ai' ELSE 'user' END AS source,
                  CASE d.doc_id % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'fresh' ELSE 'orphaned' END AS status,
                  concat('m', d.doc_id % 2) AS model, CASE WHEN d.doc_id % 5 = 0 THEN 'p1' END AS provider, CASE WHEN k = 0 THEN substr(d.text, 1, 24) END AS quoted_text
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id, (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS f""",
    ),
    "edges": (
        ("lineitem",),
        """SELECT l_orderkey * 10 + l_linenumber AS id, concat('d', l_partkey) AS from_id, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'd' ELSE 'x' END, l_suppkey) AS to_id,
                  CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'ai' END AS source, CASE WHEN l_linestatus = 'O' THEN 'fresh' WHEN l_linenumber % 3 = 0 THEN 'orphaned' ELSE 'stale' END AS status,
                  l_discount AS confidence, CASE WHEN l_linenumber % 4 <> 0 THEN concat('order ', l_orderkey) END AS quoted_text FROM lineitem""",
    ),
    "jobs": (
        ("events",),
        """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'enrich' ELSE 'refresh' END AS type,
                  CASE WHEN event_id % 3 = 2 THEN concat('x', (event_id * event_id) % 1009) WHEN event_id % 2 = 0 THEN concat('x', event_id % 251, '.1') ELSE concat('d', (event_id * 7) % 1009, '.1') END AS target_version,
                  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('v', event_id % 2) END AS prompt_ver,
                  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'dead' END AS status,
                  event_type = 'signup' AND event_id % 2 = 0 AS refusal, CASE WHEN event_id % 3 = 0 THEN 'p1' END AS refusal_provider, concat('m', event_id % 2) AS refusal_model, ts AS created
           FROM events""",
    ),
    "egress_log": (("events",), "SELECT event_id AS id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'qa' WHEN event_type = 'error' THEN 'tool' ELSE 'enrich' END AS purpose, concat('m', user_id % 3) AS model FROM events"),
    "questions": (("benchmark",), "SELECT item_id AS query_id, text AS item, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') AS question FROM benchmark WHERE item_id IS NOT NULL"),
}
_SPARK = {"questions": "SELECT item_id AS query_id, text AS item, array_join(slice(split(text, ' '), 1, 8), ' ') AS question FROM benchmark WHERE item_id IS NOT NULL"}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical or given table."""
    if name in GIVEN:
        return given(spark, sf_dir, name)
    reads, sql = MAPPINGS[name]
    sql = _SPARK.get(name, sql).replace("{ts}", "timestamp_seconds")
    for table in reads:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
    return spark.sql(sql, **{table: logical(spark, sf_dir, table) for table in reads})


def prelude(*names: str) -> str:
    """``WITH`` clause for DuckDB that defines the named logical tables and what they read."""
    wanted: dict[str, str] = {}

    def add(name: str) -> None:
        if name in GIVEN or name in wanted:
            return
        for table in MAPPINGS[name][0]:
            add(table)
        wanted[name] = MAPPINGS[name][1].replace("{ts}", "to_utc")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({re.sub(r'to_utc[(]((?:[^()]|[(][^()]*[)])*)[)]', r'make_timestamp(CAST(\1 AS BIGINT) * 1000000)', sql)})" for name, sql in wanted.items())
