"""Queries on state, links, policy, annotations, gaps and statistics, with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import blake2b_key, md5_key
from ..operators import annotations as notes_on
from ..operators import egress, gaps, links, pages, state, stats
from ..sources import files
from ..sources.mapping import logical, prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Reader:
    """Reads a folder's tables by their logical names."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, table: str) -> DataFrame:
        return logical(self.spark, self.sf_dir, table)


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a query that gets a reader of logical tables; ``sql`` follows the definitions of ``tables``."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(Reader(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"{prelude(*tables)}\n{sql}" if any(t for t in tables) else sql
        return build

    return add


NOW = "TIMESTAMP '2024-02-03 00:00:00'"
_LIVE = """heads AS (SELECT n.note_id AS node, n.head_version_id AS target_version, n.no_egress FROM notes n JOIN versions v ON v.version_id = n.head_version_id WHERE v.op <> 'delete'
 UNION SELECT e.external_id, e.head_snapshot_id, e.no_egress FROM externals e JOIN snapshots s ON s.snapshot_id = e.head_snapshot_id WHERE s.status <> 'tombstone')"""
_FIRST = r"coalesce(list_filter(list_transform(string_split_regex({}, '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: x <> '')[1], '')"
STATE = ("notes", "versions", "externals", "snapshots")


# A: sources and sinks


@query("a2_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def _(t):
    return files.parse_props(t("events"), "props", "k long").select("event_id", "props.k")


@query("a3_replace_by_key", "SELECT doc_id AS target_version, CASE WHEN doc_id % 10 = 0 THEN upper(source) ELSE source END AS value FROM documents WHERE doc_id % 20 <> 0")
def _(t):
    docs = t("documents").select(F.col("doc_id").alias("target_version"), F.col("source").alias("value"))
    new = docs.filter("target_version % 20 = 10").withColumn("value", F.upper("value"))
    return files.replace_by_key(docs, new, docs.filter("target_version % 10 = 0"))


@query(
    "a4_payload_export",
    """, l AS (SELECT DISTINCT from_id AS note_id, to_id AS external_id FROM edges WHERE source = 'user' AND from_id IN (SELECT note_id FROM doc_notes)),
k AS (SELECT l.*, e.head_snapshot_id, row_number() OVER (PARTITION BY note_id ORDER BY l.external_id) AS n FROM l JOIN externals e USING (external_id))
SELECT note_id, n, k.external_id, s.raw_payload AS payload FROM k JOIN snapshots s ON s.snapshot_id = k.head_snapshot_id WHERE s.raw_payload IS NOT NULL AND s.raw_payload <> ''""",
    "edges", "doc_notes", "externals", "snapshots",
)
def _(t):
    return files.export_payloads(t("doc_notes"), t("edges"), t("externals"), t("snapshots"))


# B: version chains, heads, snapshots

_FRAME = "from_hex(printf('%016x', octet_length(encode({0})))) || encode({0})"


@query(
    "b1_content_keys",
    f"""WITH k AS (SELECT doc_id, md5({_FRAME.format("concat('d', doc_id)")} || {_FRAME.format("''")} || {_FRAME.format("coalesce(text, '')")}) AS version_key, md5({_FRAME.format("coalesce(text, '')")}) AS body_key FROM documents)
SELECT doc_id, version_key, body_key, count(*) OVER (PARTITION BY body_key) AS copies FROM k""",
)
def _(t):
    rows = t("documents").select("doc_id", md5_key(F.concat(F.lit("d"), "doc_id"), F.lit(""), F.col("text")).alias("version_key"), md5_key(F.col("text")).alias("body_key"))
    return rows.join(rows.groupBy("body_key").agg(F.count("*").alias("copies")), "body_key")


@query("b1_blake2b_keys")
def _(t):
    return t("documents").select("doc_id", blake2b_key(F.concat(F.lit("d"), "doc_id"), F.lit(""), F.col("text")).alias("version_key"))


def _log(t) -> DataFrame:
    stale = (F.col("conv_id") % 9 == 0) & (F.col("seq") == 2)
    action = F.when((F.col("seq") > 1) & (F.col("seq") == F.col("n")) & (F.col("conv_id") % 7 == 0), "delete").otherwise("save")
    parent = F.when(stale, "stale").when(F.col("seq") == 1, "").otherwise("@head")
    return t("turns").select(F.concat(F.lit("c"), "conv_id").alias("note_id"), F.col("seq").cast("long").alias("seq"), action.alias("action"), "body", parent.alias("parent"))


@query(
    "b2_replay",
    """, l AS (SELECT concat('c', conv_id) AS note_id, seq, body, conv_id % 9 = 0 AND seq = 2 AS stale, seq > 1 AND seq = n AND conv_id % 7 = 0 AS deletes FROM turns),
p AS (SELECT *, lag(body) OVER (PARTITION BY note_id, stale ORDER BY seq) AS before FROM l)
SELECT note_id, seq, CASE WHEN stale THEN 'conflict' WHEN seq = 1 THEN 'created' WHEN deletes THEN 'deleted' WHEN body = before THEN 'noop' ELSE 'updated' END AS outcome FROM p""",
    "turns",
)
def _(t):
    return state.replay(_log(t)).select("note_id", "seq", "outcome")


@query("b2_without_noops", ", p AS (SELECT note_id, version_id, body, lag(body) OVER (PARTITION BY note_id ORDER BY version_id) AS before, row_number() OVER (PARTITION BY note_id ORDER BY version_id) AS r FROM versions) SELECT note_id, version_id FROM p WHERE r = 1 OR body <> before", "versions")
def _(t):
    return state.without_noops(t("versions").withColumn("seq", F.col("version_id"))).select("note_id", "version_id")


@query("b3_live_heads", f", {_LIVE} SELECT DISTINCT target_version FROM heads", *STATE)
def _(t):
    return state.live_heads(*map(t, STATE))


@query(
    "b4_live_notes",
    f""", c AS (SELECT note_id, count(*) AS versions FROM versions GROUP BY 1),
l AS (SELECT n.note_id, n.inserted, c.versions, {_FIRST.format("v.body")} AS summary FROM notes n JOIN versions v ON v.version_id = n.head_version_id JOIN c ON c.note_id = n.note_id WHERE v.op <> 'delete')
SELECT note_id, versions, summary, row_number() OVER (ORDER BY inserted DESC) AS position FROM l""",
    "notes", "versions",
)
def _(t):
    return state.list_notes(t("notes"), t("versions"), t("annotations"))


@query("b5_deleted_notes", f", c AS (SELECT note_id, count(*) AS versions FROM versions GROUP BY 1) SELECT n.note_id, c.versions, {_FIRST.format('v.body')} AS summary FROM notes n JOIN versions v ON v.version_id = n.head_version_id JOIN c ON c.note_id = n.note_id WHERE v.op = 'delete'", "notes", "versions")
def _(t):
    return state.list_deleted_notes(t("notes"), t("versions"))


@query(
    "b6_history",
    """, walk AS (SELECT n.note_id, v.version_id, v.parent_version_id, 0 AS back FROM notes n JOIN versions v ON v.version_id = n.head_version_id
UNION ALL SELECT w.note_id, v.version_id, v.parent_version_id, back + 1 FROM walk w JOIN versions v ON v.version_id = w.parent_version_id)
SELECT note_id, version_id, CAST(max(back) OVER (PARTITION BY note_id) - back + 1 AS BIGINT) AS seq FROM walk""",
    "notes", "versions",
)
def _(t):
    return state.history(t("notes"), t("versions"))


SQL["b6_history"] = SQL["b6_history"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "b7_purge",
    """SELECT 'version' AS kind, version_id AS id, CASE WHEN conv_id % 11 = 0 THEN '[purged]' ELSE body END AS body FROM versions JOIN (SELECT note_id, CAST(substr(note_id, 2) AS BIGINT) AS conv_id FROM notes) USING (note_id)
UNION ALL SELECT 'passage', version_id, NULL FROM versions JOIN (SELECT note_id, CAST(substr(note_id, 2) AS BIGINT) AS conv_id FROM notes) USING (note_id) WHERE conv_id % 11 <> 0""",
    "notes", "versions",
)
def _(t):
    versions = t("versions")
    listed = t("notes").filter("inserted % 11 = 0")
    out = state.purge(versions, t("annotations"), versions.select(F.col("version_id").alias("target_version")), listed, F.current_timestamp())
    return out["versions"].select(F.lit("version").alias("kind"), F.col("version_id").alias("id"), "body").unionByName(out["passages"].select(F.lit("passage").alias("kind"), F.col("target_version").alias("id"), F.lit(None).cast("string").alias("body")))


@query(
    "b8_prefixes",
    """, p AS (SELECT DISTINCT substr(note_id, 1, CASE WHEN inserted % 2 = 0 THEN 2 ELSE 3 END) AS prefix FROM notes UNION SELECT '' UNION SELECT 'zz'),
l AS (SELECT n.note_id FROM notes n JOIN versions v ON v.version_id = n.head_version_id WHERE v.op <> 'delete'),
f AS (SELECT prefix, list_sort(list(note_id) FILTER (note_id IS NOT NULL)) AS ids FROM p LEFT JOIN l ON prefix <> '' AND starts_with(note_id, prefix) GROUP BY prefix)
SELECT prefix, CASE WHEN coalesce(len(ids), 0) = 0 THEN 'missing' WHEN len(ids) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, CAST(coalesce(len(ids), 0) AS BIGINT) AS candidates, ids[1] AS first FROM f""",
    "notes", "versions",
)
def _(t):
    notes = t("notes")
    prefixes = notes.select(F.expr("substr(note_id, 1, CASE WHEN inserted % 2 = 0 THEN 2 ELSE 3 END)").alias("prefix"))
    prefixes = prefixes.union(prefixes.sparkSession.createDataFrame([("",), ("zz",)], "prefix string"))
    return state.resolve_prefixes(prefixes, notes, t("versions"))[0].withColumnRenamed("note_id", "first")


@query(
    "b8_candidates",
    f""", p AS (SELECT DISTINCT substr(note_id, 1, CASE WHEN inserted % 2 = 0 THEN 2 ELSE 3 END) AS prefix FROM notes),
l AS (SELECT n.note_id, n.created, {_FIRST.format("v.body")} AS summary, v.op = 'delete' AS deleted FROM notes n JOIN versions v ON v.version_id = n.head_version_id)
SELECT prefix, note_id, created, summary, deleted FROM p JOIN l ON starts_with(note_id, prefix)""",
    "notes", "versions",
)
def _(t):
    prefixes = t("notes").select(F.expr("substr(note_id, 1, CASE WHEN inserted % 2 = 0 THEN 2 ELSE 3 END)").alias("prefix"))
    return state.resolve_prefixes(prefixes, t("notes"), t("versions"), include_deleted=True)[1]


_FETCH = "SELECT regexp_extract(url, '://([^/]+)', 1) AS external_id, page_id AS ord, CASE WHEN page_id % 3 = 0 THEN coalesce(html, '') ELSE regexp_extract(url, '://[^/]+/([^/]+)', 1) END AS body, CASE WHEN page_id % 4 = 0 THEN 'tombstone' ELSE 'ok' END AS status FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL"


@query(
    "b9_ingest",
    f"""WITH f AS ({_FETCH}), w AS (SELECT *, lag(body) OVER (PARTITION BY external_id ORDER BY ord) AS before, min(ord) OVER (PARTITION BY external_id, body) AS first FROM f),
b AS (SELECT external_id, body, min(ord) AS first_order, arg_min(status, ord) AS status, max(ord) FILTER (ord = first OR (body = before AND status = 'ok')) AS touched FROM w GROUP BY 1, 2),
h AS (SELECT external_id, arg_max(body, ord) AS head FROM f GROUP BY 1)
SELECT external_id, body, status, first_order, touched AS fetched_at, body = head AS is_head FROM b JOIN h USING (external_id)""",
)
def _(t):
    part = lambda p: F.regexp_extract("url", p, 1)
    rows = t("pages").filter("url is not null and page_id is not null").select(part("://([^/]+)").alias("external_id"), F.col("page_id").alias("order"), F.when(F.col("page_id") % 3 == 0, F.coalesce("html", F.lit(""))).otherwise(part("://[^/]+/([^/]+)")).alias("body"), F.when(F.col("page_id") % 4 == 0, "tombstone").otherwise("ok").alias("status"), F.col("page_id").alias("fetched_at"))
    return state.ingest(rows)


# The oracle takes pages apart at "<": what stands in an open script, style or title is told by counting their tags.
_PIECES = """pieces AS (SELECT page_id, unnest(string_split(coalesce(html, ''), '<')) AS piece, unnest(range(len(string_split(coalesce(html, ''), '<')))) AS k FROM pages),
kinds AS (SELECT *, CASE WHEN k > 0 AND regexp_matches(piece, '^(?i)(script|style|title)[ >]') THEN 1 WHEN regexp_matches(piece, '^(?i)/(script|style|title) *>') THEN -1 ELSE 0 END AS opens FROM pieces),
shown AS (SELECT page_id, k, sum(opens) OVER (PARTITION BY page_id ORDER BY k) AS depth, CASE WHEN k = 0 THEN piece WHEN starts_with(piece, '!--') THEN split_part(piece, '-->', 2) ELSE substr(piece, strpos(piece, '>') + 1) END AS t FROM kinds),
joined AS (SELECT page_id, string_agg(CASE WHEN depth > 0 THEN '' ELSE t END, ' ' ORDER BY k) AS t FROM shown GROUP BY 1),
texts AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM joined)"""
_CODE = "CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 17 = 0 THEN 503 WHEN page_id % 19 = 0 THEN 429 ELSE 200 END"


@query(
    "b10_page_snapshots",
    f"""WITH {_PIECES}, p AS (SELECT concat('x', page_id) AS external_id, {_CODE} AS code, text FROM texts)
SELECT external_id, CASE WHEN code = 404 OR length(text) < 200 THEN 'tombstone' ELSE 'ok' END AS status, CASE WHEN code = 404 THEN '[tombstone: http_404]' WHEN length(text) < 200 THEN '[tombstone: empty_extract]' ELSE text END AS body FROM p WHERE code NOT IN (503, 429)""",
)
def _(t):
    fetches = t("pages").select(F.concat(F.lit("x"), "page_id").alias("external_id"), F.expr(_CODE).alias("code"), "html")
    return pages.build_snapshots(fetches)[0].select("external_id", "status", "body")


@query(
    "b11_predecessors",
    ", p AS (SELECT a.snapshot_id, b.snapshot_id AS predecessor_id, row_number() OVER (PARTITION BY a.snapshot_id ORDER BY b.fetched_at DESC, b.inserted DESC) AS r FROM snapshots a JOIN snapshots b ON a.external_id = b.external_id AND a.snapshot_id <> b.snapshot_id) SELECT snapshot_id, predecessor_id FROM p WHERE r = 1",
    "snapshots",
)
def _(t):
    return state.predecessors(t("snapshots"))


@query("b12_set_flags", ", l AS (SELECT DISTINCT concat('c', page_id) AS note_id FROM pages WHERE page_id % 3 = 0) SELECT n.note_id, CASE WHEN l.note_id IS NOT NULL THEN true ELSE n.no_egress END AS no_egress FROM notes n LEFT JOIN l ON l.note_id = n.note_id", "notes")
def _(t):
    return state.set_flags(t("notes"), "note_id", t("pages").filter("page_id % 3 = 0").select(F.concat(F.lit("c"), "page_id").alias("note_id")), True)[0].select("note_id", "no_egress")


# D: links


def _bodies(t) -> DataFrame:
    return t("pages").filter("url is not null").select("page_id", F.concat(F.lit("See "), "url", F.lit(", then ("), "url", F.lit(") or https://acme.atlassian.net/browse/ABC-"), "page_id", F.lit("! Also XY-"), "page_id", F.lit(" and ABC-1 ABC-2x.")).alias("body"))


@query("d1_urls", "SELECT page_id, url, CAST(1 AS BIGINT) AS position FROM pages UNION ALL SELECT page_id, concat('https://acme.atlassian.net/browse/ABC-', page_id), CAST(2 AS BIGINT) FROM pages")
def _(t):
    return links.extract_urls(_bodies(t), "page_id")


_CANON = r"regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=feed$', ''), '/+($|\?)', '\1')"


@query("d2_canonical", f"SELECT {_CANON} AS external_id, count(DISTINCT url) AS variants, count(*) AS links FROM pages GROUP BY 1")
def _(t):
    return links.canonical_sources(t("pages"))[0]


@query("d3_source_class", f"SELECT page_id, 'web' AS source_type, {_CANON} AS external_id FROM pages UNION ALL SELECT page_id, 'jira', concat('ABC-', page_id) FROM pages")
def _(t):
    return links.classify_sources(links.extract_urls(_bodies(t), "page_id")).select("page_id", "source_type", "external_id")


@query("d4_bare_keys", "SELECT page_id, concat('XY-', page_id) AS key FROM pages UNION ALL SELECT page_id, 'ABC-1' FROM pages")
def _(t):
    return links.bare_keys(_bodies(t), "page_id", ("ABC", "XY")).select("page_id", "key")


def _new_links(t) -> DataFrame:
    return links.classify_sources(links.extract_urls(_bodies(t), "page_id")).select(F.concat(F.lit("n"), F.col("page_id") % 50).alias("note_id"), "external_id", "url", (F.col("page_id") * 2 + F.col("position")).alias("position"))


@query(
    "d5_new_edges",
    f"""WITH l AS (SELECT concat('n', page_id % 50) AS from_id, {_CANON} AS to_id, url, page_id * 2 + 1 AS p FROM pages UNION ALL SELECT concat('n', page_id % 50), concat('ABC-', page_id), concat('https://acme.atlassian.net/browse/ABC-', page_id), page_id * 2 + 2 FROM pages)
SELECT from_id, to_id, arg_min(url, p) AS quoted_text FROM l WHERE NOT (from_id = 'n7' AND starts_with(to_id, 'ABC')) GROUP BY 1, 2""",
)
def _(t):
    rows = _new_links(t)
    old = rows.filter("note_id = 'n7' and external_id like 'ABC%'").select(F.col("note_id").alias("from_id"), F.col("external_id").alias("to_id"), F.lit("user").alias("source"))
    return links.build_edges(rows, old)[0].select("from_id", "to_id", "quoted_text")


@query("d6_repointed", ", m AS (SELECT concat('x', page_id) AS old_id, concat('y', page_id) AS new_id FROM pages WHERE page_id % 2 = 0) SELECT id, from_id, CASE WHEN source = 'user' AND new_id IS NOT NULL THEN new_id ELSE to_id END AS to_id FROM edges LEFT JOIN m ON old_id = to_id", "edges")
def _(t):
    moved = t("pages").filter("page_id % 2 = 0").select(F.concat(F.lit("x"), "page_id").alias("old_id"), F.concat(F.lit("y"), "page_id").alias("new_id"))
    return links.repoint(t("edges"), moved).select("id", "from_id", "to_id")


def _backfill(t) -> dict[str, DataFrame]:
    edges = t("pages").select(F.col("page_id").alias("id"), F.concat(F.lit("n"), F.col("page_id") % 50).alias("from_id"), F.concat(F.lit("x"), "page_id").alias("to_id"), F.lit("user").alias("source"), F.col("url").alias("quoted_text"))
    live = _bodies(t).select(F.concat(F.lit("n"), F.col("page_id") % 50).alias("note_id"), "body")
    return links.backfill(edges, t("externals"), t("snapshots"), live=live, projects=("XY",))


@query("d7_backfill", f", f AS (SELECT DISTINCT {_CANON} AS c FROM pages UNION SELECT concat('XY-', page_id) FROM pages) SELECT c AS external_id FROM f WHERE c NOT IN (SELECT external_id FROM externals)", "externals")
def _(t):
    return _backfill(t)["mint"].select("external_id")


@query("d7_counts", f"SELECT 'mint' AS what, (SELECT count(DISTINCT {_CANON}) FROM pages) + (SELECT count(*) FROM pages) AS n UNION ALL SELECT 'repoint', count(*) FROM pages UNION ALL SELECT 'link', count(*) FROM pages UNION ALL SELECT 'refresh', (SELECT count(DISTINCT {_CANON}) FROM pages) + (SELECT count(*) FROM pages)")
def _(t):
    return _backfill(t)["counts"]


@query(
    "d3_configured_sites",
    f"""WITH h AS (SELECT page_id, {_CANON} AS c, regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id % 3 AS k FROM pages)
SELECT page_id, CASE WHEN k = 0 THEN 'jira' ELSE 'web' END AS source_type, CASE WHEN k = 0 THEN concat('AB-', page_id) WHEN k = 1 THEN concat('https://evil-issues.example.org/browse/AB-', page_id) ELSE concat('https://x.atlassian.net/browse/AB-', page_id) END AS external_id,
 CASE WHEN k = 0 THEN 'https://Issues.example.org/base' END AS api_base FROM h""",
)
def _(t):
    host = F.element_at(F.array(F.lit("Issues.Example.org:8443"), F.lit("evil-issues.example.org"), F.lit("x.atlassian.net")), (F.col("page_id") % 3 + 1).cast("int"))
    rows = t("pages").select("page_id", F.concat(F.lit("https://"), host, F.lit("/browse/AB-"), "page_id").alias("url"))
    return links.classify_sources(rows, {"jira": "https://Issues.example.org/base/"}).drop("url")


# G: egress


@query("g1_sendable", " SELECT note_id, no_egress FROM notes WHERE NOT no_egress", "notes")
def _(t):
    return egress.partition_items(t("notes"))[0].select("note_id", "no_egress")


@query("g2_scoped", "SELECT page_id, CASE WHEN page_id % 10 = 3 THEN page_id % 20 = 3 ELSE lower(regexp_extract(url, '://([^/?#:]*)', 1)) IN (SELECT DISTINCT regexp_extract(url, '://([^/?#:]*)', 1) FROM pages WHERE page_id % 7 = 0) END AS scoped FROM pages WHERE url IS NOT NULL")
def _(t):
    rows = t("pages").filter("url is not null")
    things = rows.select("page_id", F.when(F.col("page_id") % 10 == 3, "jira").otherwise("web").alias("source_type"), F.expr("CASE WHEN page_id % 20 = 3 THEN concat('ABC-', page_id) WHEN page_id % 10 = 3 THEN concat('XYZ-', page_id) ELSE url END").alias("external_id"))
    rules = rows.filter("page_id % 7 = 0").select(F.lit("web").alias("source_type"), F.regexp_extract("url", "://([^/?#:]*)", 1).alias("match"))
    rules = rules.union(rules.sparkSession.createDataFrame([("jira", "ABC")], "source_type string, match string"))
    return egress.scoped(things, rules).select("page_id", "scoped")


@query(
    "g3_egress_gate",
    r""", l AS (SELECT doc_id, note_id, unnest(string_split(body, chr(10))) AS text, unnest(range(len(string_split(body, chr(10))))) AS line FROM doc_notes WHERE NOT no_egress),
i AS (SELECT doc_id // 100 AS batch_id, note_id AS target_id, doc_id * 1000000 + line AS ord, len(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS n FROM l),
t AS (SELECT batch_id, target_id, coalesce(arg_max(n, ord) FILTER (n > 0), 0) AS spans FROM i GROUP BY ALL)
SELECT batch_id, count(*) AS sent, md5(string_agg(target_id, ',' ORDER BY ord)) AS sent_digest, (SELECT count(*) FROM t WHERE t.batch_id = i.batch_id AND spans > 0) AS redacted, (SELECT CAST(sum(spans) AS BIGINT) FROM t WHERE t.batch_id = i.batch_id) AS spans FROM i GROUP BY batch_id""",
    "doc_notes",
)
def _(t):
    from ..operators.text import SECRETS, TOKEN_ASSIGNMENT

    # each line of a document is a passage of it
    lines = t("doc_notes").select("doc_id", F.col("note_id").alias("target_id"), "no_egress", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    items = lines.select(F.expr("doc_id div 100").alias("batch_id"), (F.col("doc_id") * 1_000_000 + F.col("line")).alias("ord"), "target_id", "text", "no_egress")
    rows = egress.audit_rows(egress.gate(items, SECRETS | TOKEN_ASSIGNMENT)[2], "qa", "m1")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    r = F.map_values(F.coalesce("redactions", none))
    total = F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("batch_id", F.size("sent_targets").cast("long").alias("sent"), F.md5(F.array_join("sent_targets", ",")).alias("sent_digest"), F.size(r).cast("long").alias("redacted"), total.alias("spans"))


@query(
    "g3_withheld",
    "SELECT doc_id // 100 AS batch_id, count(*) AS withheld FROM doc_notes WHERE no_egress GROUP BY 1",
    "doc_notes",
)
def _(t):
    items = t("doc_notes").select(F.expr("doc_id div 100").alias("batch_id"), F.col("doc_id").alias("ord"), F.col("note_id").alias("target_id"), F.col("body").alias("text"), "no_egress")
    return egress.gate(items)[1].groupBy("batch_id").agg(F.count("*").alias("withheld"))


@query("g4_audit_list", " SELECT id, ts, model FROM egress_log WHERE purpose = 'qa'", "egress_log")
def _(t):
    return egress.list_log(t("egress_log"), "qa").select("id", "ts", "model")


@query("g4_audit_counts", " SELECT purpose, count(*) AS n FROM egress_log GROUP BY 1", "egress_log")
def _(t):
    return egress.purpose_counts(t("egress_log"))


# H: annotations

_SHOWN = "shown AS (SELECT *, status <> 'fresh' AS stale FROM annotations WHERE NOT (source = 'user' AND status = 'orphaned') AND NOT (kind = 'action_item' AND status <> 'fresh'))"
_RESULT = "concat('d', doc_id) AS target, concat('d', doc_id, '.1') AS source_version, 'tag' AS kind, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'new' END AS payload"


@query(
    "h1_load",
    f""", r AS (SELECT DISTINCT {_RESULT} FROM documents),
u AS (SELECT DISTINCT target, kind, payload FROM annotations WHERE source = 'user')
SELECT target, source_version, kind, payload, source FROM annotations WHERE NOT (source = 'ai' AND source_version IS NOT NULL AND source_version IN (SELECT source_version FROM r))
UNION ALL SELECT r.target, r.source_version, r.kind, r.payload, 'ai' FROM r LEFT JOIN u ON u.target = r.target AND u.kind = r.kind AND u.payload = r.payload WHERE u.target IS NULL""",
    "annotations",
)
def _(t):
    results = t("documents").selectExpr("concat('d', doc_id) AS target", "concat('d', doc_id, '.1') AS source_version", "'tag' AS kind", "CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'new' END AS payload")
    return notes_on.load_enrichment(t("annotations"), results).select("target", "source_version", "kind", "payload", "source")


@query(
    "h2_targets",
    f""", i AS (SELECT DISTINCT target_version FROM jobs), {_LIVE.replace("heads AS", "alive AS")}
SELECT i.target_version, CASE WHEN v.version_id IS NULL AND s.snapshot_id IS NULL THEN 'unknown' WHEN i.target_version NOT IN (SELECT target_version FROM alive) THEN 'dead'
 WHEN coalesce(n.no_egress, e.no_egress) THEN 'withheld' ELSE 'ready' END AS outcome
FROM i LEFT JOIN versions v ON v.version_id = i.target_version LEFT JOIN notes n ON n.note_id = v.note_id LEFT JOIN snapshots s ON s.snapshot_id = i.target_version LEFT JOIN externals e ON e.external_id = s.external_id""",
    *STATE, "jobs",
)
def _(t):
    ready, skipped = notes_on.enrichment_targets(t("jobs"), *map(t, STATE))
    return ready.select("target_version", F.lit("ready").alias("outcome")).unionByName(skipped.withColumnRenamed("reason", "outcome"))


@query(
    "h3_reanchor",
    """, h AS (SELECT note_id, concat(note_id, '.2') AS head, CASE WHEN doc_id % 2 = 0 THEN substr(body, 5) ELSE concat(upper(body), ' ', doc_id) END AS body FROM doc_notes),
j AS (SELECT a.*, h.head, h.body, a.source = 'ai' AND h.head IS NOT NULL AS moves FROM annotations a LEFT JOIN h ON h.note_id = a.target),
s AS (SELECT *, CASE WHEN NOT moves THEN status WHEN quoted_text IS NOT NULL THEN CASE WHEN contains(body, quoted_text) THEN 'fresh' WHEN contains(body, payload) THEN 'stale' ELSE 'orphaned' END
 WHEN contains(body, payload) THEN 'fresh' ELSE 'orphaned' END AS now FROM j)
SELECT id, now AS status, CASE WHEN moves AND now = 'fresh' THEN head ELSE source_version END AS source_version FROM s""",
    "annotations", "doc_notes",
)
def _(t):
    edited = F.when(F.col("doc_id") % 2 == 0, F.substring("body", 5, 1_000_000_000)).otherwise(F.concat(F.upper("body"), F.lit(" "), "doc_id"))
    heads = t("doc_notes").select(F.col("note_id").alias("target"), F.concat("note_id", F.lit(".2")).alias("head_version_id"), edited.alias("body"))
    return notes_on.reanchor(t("annotations"), heads, "target", "payload").select("id", "status", "source_version")


@query("h4_suppress", " SELECT id, CASE WHEN id % 7 = 0 THEN 'user' ELSE source END AS source, CASE WHEN id % 7 = 0 THEN 'orphaned' ELSE status END AS status, CASE WHEN id % 7 <> 0 THEN source_version END AS source_version FROM annotations", "annotations")
def _(t):
    rows = t("annotations")
    return notes_on.suppress(rows, rows.filter("id % 7 = 0")).select("id", "source", "status", "source_version")


@query("h5_display_counts", f", {_SHOWN} SELECT target, kind, count(*) AS visible, count(*) FILTER (stale) AS stale FROM shown GROUP BY 1, 2", "annotations")
def _(t):
    return notes_on.display_counts(t("annotations"))


@query("h5_display_edges", " SELECT id, status <> 'fresh' AS stale FROM edges WHERE NOT (source = 'user' AND status = 'orphaned')", "edges")
def _(t):
    return notes_on.displayed(t("edges")).select("id", "stale")


@query("h6_tags", f", {_SHOWN} SELECT DISTINCT payload FROM shown WHERE kind = 'tag' AND payload IS NOT NULL", "annotations")
def _(t):
    return notes_on.tags(t("annotations"))


@query(
    "h7_notes_with_tags",
    f""", {_SHOWN}, own AS (SELECT target AS note_id, payload FROM shown WHERE kind = 'tag'),
linked AS (SELECT DISTINCT e.from_id AS note_id, s.payload FROM edges e JOIN shown s ON s.target = e.to_id WHERE e.status = 'fresh' AND s.kind = 'tag'),
alltags AS (SELECT * FROM own UNION SELECT * FROM linked)
SELECT note_id FROM alltags WHERE payload IN ('en', 'de') AND note_id IN (SELECT note_id FROM doc_notes) GROUP BY 1 HAVING count(DISTINCT payload) = 2""",
    "annotations", "edges", "doc_notes",
)
def _(t):
    notes = t("doc_notes")
    asked = t("documents").filter("lang in ('en', 'de')").select(F.col("lang").alias("payload"))
    return notes_on.notes_with_all_tags(notes, t("annotations"), t("edges"), asked)


@query(
    "h8_inherited_tags",
    f""", {_SHOWN}, t AS (SELECT target, payload, stale FROM shown WHERE kind = 'tag' AND payload IS NOT NULL)
SELECT e.from_id AS note_id, t.payload, bool_and(t.stale) AS stale FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE status = 'fresh') e JOIN t ON t.target = e.to_id
WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.target = e.from_id AND o.payload = t.payload) GROUP BY 1, 2""",
    "annotations", "edges",
)
def _(t):
    return notes_on.inherited_tags(t("annotations"), t("edges"))


@query(
    "h9_enrichment_view",
    f""", {_SHOWN}, a AS (SELECT target, list_sort(list(DISTINCT payload) FILTER (kind = 'tag')) AS tags, list_sort(list(DISTINCT payload) FILTER (kind = 'entity')) AS entities,
 arg_min(payload, (CASE WHEN stale THEN 1 ELSE 0 END) * 1000000000000 + id) FILTER (kind = 'summary') AS summary FROM shown WHERE payload IS NOT NULL GROUP BY 1),
l AS (SELECT from_id, count(*) AS links, count(*) FILTER (status <> 'fresh') AS stale_links FROM edges WHERE NOT (source = 'user' AND status = 'orphaned') GROUP BY 1),
xe AS (SELECT l.from_id, count(*) FILTER (e.no_egress) AS withheld, count(*) FILTER (NOT e.no_egress AND s.status = 'tombstone') AS stale_externals, count(*) FILTER (NOT e.no_egress AND s.status <> 'tombstone') AS un_refreshed
 FROM edges l JOIN externals e ON e.external_id = l.to_id JOIN snapshots s ON s.snapshot_id = e.head_snapshot_id WHERE NOT (l.source = 'user' AND l.status = 'orphaned') GROUP BY 1),
w AS (SELECT target_version, bool_or(status IN ('pending', 'running')) AS pending, bool_or(status IN ('failed', 'dead')) AS failed FROM jobs WHERE type = 'enrich' GROUP BY 1)
SELECT n.note_id, a.summary, array_to_string(coalesce(a.tags, []), ',') AS tags, array_to_string(coalesce(a.entities, []), ',') AS entities, coalesce(l.links, 0) AS links, coalesce(l.stale_links, 0) AS stale_links, coalesce(xe.withheld, 0) AS withheld, coalesce(xe.stale_externals, 0) AS stale_externals, coalesce(xe.un_refreshed, 0) AS un_refreshed, CAST(1 AS BIGINT) AS passages,
 CASE WHEN EXISTS (SELECT 1 FROM annotations x WHERE x.source = 'ai' AND x.source_version = n.head_version_id) THEN 'ready' WHEN w.pending THEN 'pending' WHEN w.failed THEN 'failed' ELSE 'pending' END AS state,
 EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = n.doc_id) AS embedded
FROM doc_notes n LEFT JOIN a ON a.target = n.note_id LEFT JOIN l ON l.from_id = n.note_id LEFT JOIN xe ON xe.from_id = n.note_id LEFT JOIN w ON w.target_version = n.head_version_id""",
    "annotations", "edges", "jobs", "doc_notes", "externals", "snapshots",
)
def _(t):
    notes = t("doc_notes")
    vectors = t("embeddings").select(F.concat(F.lit("d"), "vec_id", F.lit(".1")).alias("target_version"))
    view = notes_on.enrichment_view(notes, t("annotations"), t("edges"), t("jobs"), notes.select(F.col("head_version_id").alias("target_version")), vectors, t("externals"), t("snapshots"))
    return view.withColumns({c: F.array_join(c, ",") for c in ("tags", "entities")})


@query(
    "h10_stale_models",
    """ SELECT DISTINCT n.head_version_id AS target_version FROM doc_notes n WHERE NOT n.no_egress
AND EXISTS (SELECT 1 FROM annotations a WHERE a.source_version = n.head_version_id AND a.source = 'ai' AND (a.model <> 'm1' OR a.provider IS NOT NULL))
AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.target_version = n.head_version_id AND j.type = 'enrich' AND j.refusal AND j.refusal_model = 'm1' AND j.refusal_provider IS NULL)""",
    "annotations", "doc_notes", "jobs",
)
def _(t):
    return notes_on.stale_heads(t("doc_notes").withColumnRenamed("head_version_id", "target_version"), t("annotations"), t("jobs"), "m1", None)


def _vector_snapshots(t) -> tuple[DataFrame, DataFrame]:
    rows = t("embeddings").withColumn("target_version", F.floor(F.col("vec_id") / 4))
    snapshots = rows.groupBy("target_version").agg(F.max("vec_id").alias("inserted")).select(F.col("target_version").alias("snapshot_id"), F.floor(F.col("target_version") / 3).alias("external_id"), F.timestamp_seconds("inserted").alias("fetched_at"), "inserted")
    return snapshots, rows.select("target_version", F.col("embedding").alias("vector"))


@query(
    "h11_material",
    """WITH v AS (SELECT vec_id // 4 AS s, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT s, i, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY 1, 2),
n AS (SELECT s, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), k AS (SELECT DISTINCT s, s // 3 AS e FROM v),
p AS (SELECT a.s, max(b.s) AS b FROM k a JOIN k b ON a.e = b.e AND a.s <> b.s GROUP BY 1),
d AS (SELECT p.s, sum(a.x * c.x) / (any_value(x.n) * any_value(y.n)) AS cos FROM p JOIN m a ON a.s = p.s JOIN m c ON c.s = p.b AND c.i = a.i JOIN n x ON x.s = p.s JOIN n y ON y.s = p.b GROUP BY 1)
SELECT k.s AS snapshot_id, round(1 - d.cos, 6) AS delta, d.cos IS NULL OR 1 - d.cos >= 0.2 AS reenrich FROM k LEFT JOIN d ON d.s = k.s""",
)
def _(t):
    return notes_on.material(*_vector_snapshots(t)).withColumn("delta", F.round("delta", 6))


# I: gaps and the ledger

_BUSY = "('pending', 'running', 'failed')"


@query("i1_embedding_gap", f", {_LIVE} SELECT DISTINCT target_version FROM heads WHERE target_version NOT IN (SELECT target_version FROM jobs WHERE type = 'embed' AND status <> 'dead') AND target_version NOT IN (SELECT version_id FROM versions WHERE purged_at IS NOT NULL)", *STATE, "jobs")
def _(t):
    heads = state.live_heads(*map(t, STATE)).join(t("versions").select(F.col("version_id").alias("target_version"), F.col("purged_at").isNotNull().alias("purged")), "target_version", "left")
    return gaps.embedding_gap(heads.withColumn("purged", F.coalesce("purged", F.lit(False))), t("jobs"))


@query(
    "i2_enrichment_gap",
    f""", e AS (SELECT * FROM jobs WHERE type = 'enrich'), ok AS (SELECT head_version_id AS target_version FROM doc_notes WHERE NOT no_egress
 AND head_version_id NOT IN (SELECT target_version FROM e WHERE status IN {_BUSY} OR (status = 'done' AND prompt_ver IS NOT NULL AND prompt_ver = 'v1') OR (refusal AND refusal_model = 'm1' AND refusal_provider IS NULL))),
f AS (SELECT external_id, head_snapshot_id FROM externals WHERE NOT no_egress AND source_type <> 'jira'),
last AS (SELECT s.external_id, arg_max(struct_pack(status := e.status, p := e.prompt_ver, r := e.refusal, m := e.refusal_model, v := e.refusal_provider), e.id) AS j FROM e JOIN snapshots s ON s.snapshot_id = e.target_version GROUP BY 1)
SELECT target_version FROM ok UNION ALL SELECT head_snapshot_id FROM f LEFT JOIN last USING (external_id)
WHERE NOT coalesce(j.status IN {_BUSY} OR (j.status = 'done' AND coalesce(j.p = 'v1', false)) OR (j.r AND j.m = 'm1' AND j.v IS NULL), false)""",
    "doc_notes", "externals", "snapshots", "jobs",
)
def _(t):
    notes = t("doc_notes").select(F.col("head_version_id").alias("target_version"), "no_egress")
    ext = t("externals").join(t("snapshots").select("external_id", "snapshot_id"), "external_id").select("external_id", "snapshot_id", F.col("head_snapshot_id").alias("target_version"), "no_egress", (F.col("source_type") == "jira").alias("scoped"))
    return gaps.enrichment_gap(notes, ext, t("jobs"), "v1", "m1", None)


@query("i3_refresh_due", f" SELECT e.external_id FROM externals e JOIN snapshots s ON s.snapshot_id = e.head_snapshot_id WHERE s.status = 'ok' AND s.fetched_at <= {NOW} - INTERVAL 3600 SECOND AND e.external_id NOT IN (SELECT target_version FROM jobs WHERE type = 'refresh' AND status IN {_BUSY})", "externals", "snapshots", "jobs")
def _(t):
    return gaps.refresh_due(t("externals"), t("snapshots"), t("jobs"), F.expr(NOW))


@query("i4_lexical_gap", " SELECT head_version_id AS target_version FROM doc_notes WHERE doc_id % 6 = 0", "doc_notes")
def _(t):
    heads = t("doc_notes").select(F.col("head_version_id").alias("target_version"), "doc_id")
    return gaps.lexical_gap(heads, heads.filter("doc_id % 6 <> 0"))


@query("i5_append", f", r AS (SELECT DISTINCT 'embed' AS type, concat('x', page_id % 251, '.1') AS target_version, 'v1' AS prompt_ver FROM pages) SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.type = r.type AND j.target_version = r.target_version AND coalesce(j.prompt_ver, '') = 'v1' AND j.status IN {_BUSY})", "jobs")
def _(t):
    requests = t("pages").select(F.lit("embed").alias("type"), F.concat(F.lit("x"), F.col("page_id") % 251, F.lit(".1")).alias("target_version"), F.lit("v1").alias("prompt_ver"))
    return gaps.append_requests(t("jobs"), requests)


@query(
    "i5_compact",
    """ SELECT id FROM jobs j WHERE NOT (status = 'failed' AND (EXISTS (SELECT 1 FROM jobs o WHERE o.type = j.type AND o.target_version = j.target_version AND coalesce(o.prompt_ver, '') = coalesce(j.prompt_ver, '') AND o.status IN ('pending', 'running'))
 OR EXISTS (SELECT 1 FROM jobs o WHERE o.type = j.type AND o.target_version = j.target_version AND coalesce(o.prompt_ver, '') = coalesce(j.prompt_ver, '') AND o.status = 'failed' AND o.id > j.id)))""",
    "jobs",
)
def _(t):
    return gaps.compact(t("jobs")).select("id")


for _name, _build, _sql in (
    ("i6_status_counts", gaps.status_counts, "SELECT status, count(*) AS n FROM jobs GROUP BY 1"),
    ("i6_dead_letters", gaps.dead_letters, "SELECT id, type, target_version, refusal FROM jobs WHERE status = 'dead'"),
    ("i6_refusals", gaps.refusals, "SELECT id, type, target_version, refusal_model, refusal_provider FROM jobs WHERE status = 'dead' AND refusal"),
    ("i6_outstanding", gaps.outstanding, f"SELECT type, count(*) AS n FROM jobs WHERE status IN {_BUSY} GROUP BY 1"),
):
    query(_name, _sql, "jobs")(lambda t, build=_build: build(t("jobs")))

# J: statistics

_HEADS = "h AS (SELECT s.* FROM snapshots s WHERE s.snapshot_id IN (SELECT head_snapshot_id FROM externals))"
_REASON = r"CASE WHEN regexp_extract(body, '^\[tombstone: (.+)\]$', 1) <> '' THEN regexp_extract(body, '^\[tombstone: (.+)\]$', 1) ELSE 'other' END"
for _name, _build, _sql in (
    ("j1_snapshot_status", stats.snapshot_status, "SELECT status, count(*) AS n FROM h GROUP BY 1"),
    ("j2_tombstone_reasons", stats.tombstone_reasons, f"SELECT {_REASON} AS reason, count(*) AS n FROM h WHERE status = 'tombstone' GROUP BY 1"),
    ("j3_retained_payloads", stats.retained_payloads, f"SELECT count(*) AS n FROM h WHERE status = 'tombstone' AND raw_payload IS NOT NULL AND {_REASON} = 'empty_extract'"),
):
    query(_name, f", {_HEADS} {_sql}", "externals", "snapshots")(lambda t, build=_build: build(t("externals"), t("snapshots")))


@query("j4_note_counts", " SELECT count(*) AS total, count(*) FILTER (op <> 'delete') AS live, count(*) FILTER (op = 'delete') AS deleted FROM notes JOIN versions ON version_id = head_version_id", "notes", "versions")
def _(t):
    return stats.note_counts(t("notes"), t("versions"))


@query("j5_chains", ", d AS (SELECT count(*) AS d FROM versions GROUP BY note_id) SELECT CAST(sum(d) AS BIGINT) AS versions, max(d) AS longest, avg(d) AS average FROM d", "versions")
def _(t):
    return stats.chain_stats(t("versions"))


@query("j6_source_types", " SELECT source_type, count(*) AS n, count(*) FILTER (no_egress) AS no_egress FROM externals GROUP BY 1", "externals")
def _(t):
    return stats.source_types(t("externals"))


@query("j7_index_stats", " SELECT (SELECT count(*) FROM doc_notes) AS passages, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT head_version_id) FROM doc_notes) AS targets, (SELECT count(DISTINCT doc_id) FROM doc_notes WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS embedded, (SELECT count(DISTINCT doc_id) FROM doc_notes WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without", "doc_notes")
def _(t):
    return stats.index_stats(t("doc_notes").select(F.col("head_version_id").alias("target_version")), t("embeddings").select(F.concat(F.lit("d"), "vec_id", F.lit(".1")).alias("target_version")))


@query("j8_edges", " SELECT 'status' AS by, status AS value, count(*) AS n FROM edges GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM edges GROUP BY 2", "edges")
def _(t):
    return stats.edge_counts(t("edges"))


def _search_log(t) -> DataFrame:
    return files.parse_props(t("events"), "props", "k long").select(F.concat_ws(" ", "event_type", F.col("user_id") % 20).alias("query"), (F.col("props.k") % 10).alias("hit_count"))


_LOG = "WITH log AS (SELECT concat_ws(' ', event_type, user_id % 20) AS query, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS hit_count FROM events)"


@query("j9_search_log", f"{_LOG} SELECT count(*) AS invocations, count(*) FILTER (hit_count = 0) AS misses, count(*) FILTER (hit_count = 0) / count(*) AS miss_rate FROM log")
def _(t):
    return stats.search_log_stats(_search_log(t))


@query("j9_top_misses", f"{_LOG} SELECT query, count(*) AS n FROM log WHERE hit_count = 0 GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def _(t):
    return stats.top_misses(_search_log(t))


@query(
    "j10_tool_calls",
    """WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS role, CASE WHEN event_type IN ('view', 'click') AND user_id % 3 = 0 THEN 'index' WHEN user_id % 3 = 1 THEN 'direct' ELSE 'ambiguous' END AS kind FROM events WHERE user_id % 4 <> 0)
SELECT day, role, kind, count(*) AS n FROM c GROUP BY GROUPING SETS ((kind), (day, kind), (role, kind))""",
)
def _(t):
    name = F.when(F.expr("user_id % 3 = 1"), "Read").otherwise("Bash")
    text = F.expr("CASE WHEN user_id % 4 = 0 THEN 'ls' WHEN event_type IN ('view', 'click') AND user_id % 3 = 0 THEN 'python docs_index_query' WHEN user_id % 3 = 1 THEN 'docs/a.md' ELSE 'cat docs' END")
    sessions = t("events").select(F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("role"), F.array(F.struct(name.alias("name"), text.alias("input"))).alias("calls"))
    return stats.tool_call_totals(stats.tool_calls(sessions))
