"""Literal cases of the helpers inside column expressions, and of jobs that SQL can't express."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import passages, urls
from tessera.functions.identity import blake2b_key, content_key
from tessera.functions.recovery import written
from tessera.operators import annotations, claims, context, egress, evaluate, gaps, links, search, state, text
from tessera.functions.markup import visible_text
from tessera.sources import files
from tessera.sources.keyed import KeyedTables
from tessera.streaming import jobs


def test_blocks_and_offsets():
    body = "# Title\r\nOne line\nand more\n\n- item\n1) other\n\nLast"
    spans = [(s, e) for s, e, _ in passages.blocks(body)]
    assert [body[s:e] for s, e in spans] == ["# Title", "One line\nand more", "- item", "1) other", "Last"]
    for _, start, end, piece, parent in passages.passages(body):
        assert body[start:end] == piece
        assert parent == body.strip()
    assert passages.passages(None) == passages.passages(" \n\n") == []


def test_sections_are_parents():
    found = passages.passages("intro\n\n# A\ntext a\n## B\ntext b")
    assert [p[4] for p in found] == ["intro", "# A\ntext a", "# A\ntext a", "## B\ntext b", "## B\ntext b"]


def test_windows_overlap_and_stop():
    words = " ".join(f"w{i}" for i in range(20))
    found = [p[3].split() for p in passages.passages(words, 8, 2)]
    assert [f[0] for f in found] == ["w0", "w6", "w12"] and found[-1][-1] == "w19"
    assert passages.passages(words, 3, 9)[1][3].startswith("w1 ")  # the step is one at least


def test_fences_hide_headings():
    body = "# A\n```\n# not a heading\n```\ntext\n# B\nmore"
    assert [(a, b) for a, b, _ in passages.units(body)] == [(1, 5), (6, 7)]
    assert [(a, b) for a, b, _ in passages.units("pre\n# A\n## B\nx\n# C\n## D\n")] == [(1, 2), (3, 5), (6, 6)]
    assert [(a, b) for a, b, _ in passages.units("intro\n- a\n  more\n- b")] == [(1, 1), (2, 3), (4, 4)]
    assert [(a, b) for a, b, _ in passages.units("# A\nlong text\n\npara two\n- b\n", 12)] == [(1, 3), (4, 4), (5, 5)] and passages.units("") == []
    assert passages.fenced(["~~~~", "```", "~~~", "~~~~", "x"]) == [False, True, True, True, False]
    assert passages.fenced(["  ```py", "```py", "    ```", "x"]) == [False, True, True, False]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("HTTP://User:pw@Example.COM:80/a/b/?b=2&utm_source=x&a=1#top", "http://example.com/a/b?a=1&b=2"),
        ("https://[::1]:8443/", "https://[::1]:8443/"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:bad/", None),
        (None, None),
    ],
)
def test_canonical_urls(spark, given, expected):
    assert spark.createDataFrame([(given,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == expected


def test_canonical_of_many_forms_agrees_with_the_standard_library(spark):
    from itertools import product
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    def plain(url):
        try:
            p = urlsplit(url)
            host, port = (p.hostname or ""), p.port
        except ValueError:
            return None
        pairs = sorted(x for x in parse_qsl(p.query, keep_blank_values=True) if not x[0].lower().startswith("utm_") and x[0].lower() not in ("fbclid", "gclid"))
        host = f"[{host}]" if ":" in host else host
        host += f":{port}" if port not in (None, {"http": 80, "https": 443}[p.scheme]) else ""
        return urlunsplit((p.scheme, host, p.path.rstrip("/") or "/", urlencode(pairs), ""))

    hosts = ("E.org", "u:p@e.org:8080", "a@b@e.org", "e.org:443", "e.org:99999", "e.org:", "[2001:DB8::1]:80", "[::1", "e.org:1:2")
    queries = ("", "?", "?b=2&a=1&a=0", "?UTM_Source=x&c", "?q=%C3%A9+x%20y%zz&p=a*b~c", "?gclid=1#f?x=1", "?k=a%26b&=v&&k==")
    given = [f"{s}://{h}{p}{q}" for s, h, p, q in product(("http", "HTTPS"), hosts, ("", "/", "/a//b//", "/%7Euser/;p=1"), queries)]
    got = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == {u: plain(u) for u in given}


def test_url_spans_balance_brackets(spark):
    text = "(see https://e.org/wiki/Foo_(bar)) and <https://e.org/a>, https://e.org/b). 😀 https://e.org/(x)) https://e.org/))"
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(urls.url_spans(F.col("t")).alias("s")).collect()
    assert [s["found"] for s in found[0]["s"]] == ["https://e.org/wiki/Foo_(bar)", "https://e.org/a", "https://e.org/b", "https://e.org/(x)", "https://e.org/"]
    assert all(text[s["start"] : s["end"]] == s["found"] for s in found[0]["s"]) and not found[1]["s"] and not found[2]["s"]


@pytest.mark.parametrize(
    ("given", "sites", "expected"),
    [
        ("https://acme.atlassian.net/browse/AB-12/", None, ("jira", "AB-12", "https://acme.atlassian.net")),
        ("https://acme.atlassian.net/wiki/spaces/S/pages/77/Title", None, ("confluence", "77", "https://acme.atlassian.net")),
        ("https://acme.atlassian.net/pages/77", None, ("web", None, None)),
        ("https://example.org/browse/AB-12", None, ("web", None, None)),
        ("https://[bad/browse/AB-12", None, ("web", None, None)),
        ("https://JIRA.acme.com:8443/browse/AB-1", {"jira": "https://jira.acme.com/"}, ("jira", "AB-1", "https://jira.acme.com")),
        ("https://evil-jira.acme.com/browse/AB-1", {"jira": "https://jira.acme.com"}, ("web", None, None)),
        ("https://x.atlassian.net/browse/AB-1", {"jira": "https://jira.acme.com"}, ("web", None, None)),
        ("https://x.atlassian.net/wiki/spaces/S/pages/7", {"jira": "https://jira.acme.com"}, ("confluence", "7", "https://x.atlassian.net")),
    ],
)
def test_source_classes(spark, given, sites, expected):
    row = spark.createDataFrame([(given,)], "url string").select(*[c.alias(k) for k, c in urls.source_class(F.col("url"), sites).items()]).first()
    assert tuple(row) == expected


def test_bare_keys_stand_alone(spark):
    rows = spark.createDataFrame([("ABC-1, XABC-2 ABC-3x ABC-4.",)], "t string")
    assert [k["found"] for k in rows.select(urls.key_spans(F.col("t"), ("ABC",)).alias("k")).first()["k"]] == ["ABC-1", "ABC-4"]
    assert rows.select(urls.key_spans(F.col("t"), ()).alias("k")).first()["k"] == []


def test_blake2b_key_is_framed(spark):
    row = spark.createDataFrame([("ab", "c"), ("a", "bc")], "a string, b string").select(blake2b_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r["k"] for r in row] == [content_key("ab", "c"), content_key("a", "bc")] and row[0] != row[1]


def test_replay_of_conflicts_and_recovery(spark):
    first = content_key("n", "", "one")
    rows = [
        ("n", 1, "save", "one", ""), ("n", 2, "save", "two", "stale"), ("n", 3, "save", "one", "@head"), ("n", 4, "delete", None, "@head"), ("n", 5, "save", "one", "@head"),
        ("n", 6, "recover", None, first), ("n", 7, "delete", None, "@head"), ("n", 8, "recover", None, "nope"), ("m", 1, "save", "x", "parent"), ("m", 2, "delete", None, "@head"),
    ]
    out = {(r["note_id"], r["seq"]): r for r in state.replay(spark.createDataFrame(rows, "note_id string, seq long, action string, body string, parent string")).collect()}
    got = [out["n", i]["outcome"] for i in range(1, 9)] + [out["m", 1]["outcome"], out["m", 2]["outcome"]]
    assert got == ["created", "conflict", "noop", "deleted", "noop", "recovered", "deleted", "unknown", "conflict", "unknown"]
    assert out["n", 7]["version_id"] == out["n", 4]["version_id"] and out["n", 7]["op"] is None  # the tombstone is there already


def test_a_long_note_streams_through_its_replay(spark):
    n = 60_000
    log = spark.range(n).select(F.lit("n").alias("note_id"), (F.col("id") + 1).alias("seq"), F.lit("save").alias("action"), F.concat(F.lit("text "), F.col("id") % 977).alias("body"), F.lit("@head").alias("parent"))
    got = state.replay(log.unionByName(log.filter("seq <= 3").withColumn("note_id", F.lit("m"))))
    assert {(r["note_id"], r["outcome"]): r["n"] for r in got.groupBy("note_id", "outcome").agg(F.count("*").alias("n")).collect()} == {("n", "created"): 1, ("n", "updated"): n - 1, ("m", "created"): 1, ("m", "updated"): 2}
    last = got.filter(f"note_id = 'n' and seq = {n}").first()
    assert last["head_id"] == last["version_id"] and got.filter("note_id = 'n'").select("version_id").distinct().count() == n


def test_ingest_flip_flop(spark):
    rows = [("e", i, b, "ok", i * 10) for i, b in enumerate(["A", "A", "B", "A", "C", "B"])]
    got = {r["body"]: (r["first_order"], r["fetched_at"], r["is_head"]) for r in state.ingest(spark.createDataFrame(rows, "external_id string, `order` int, body string, status string, fetched_at int")).collect()}
    assert got == {"A": (0, 10, False), "B": (2, 20, True), "C": (4, 40, False)}


def test_history_leaves_abandoned_branches_out(spark):
    versions = spark.createDataFrame([("v1", "n", None), ("v2", "n", "v1"), ("v3", "n", "v2"), ("v2b", "n", "v1")], "version_id string, note_id string, parent_version_id string")
    notes = spark.createDataFrame([("n", "v2b")], "note_id string, head_version_id string")
    assert {(r["version_id"], r["seq"]) for r in state.history(notes, versions).collect()} == {("v1", 1), ("v2b", 2)}


def test_redaction_counts(spark):
    rows = spark.createDataFrame([(1, "key AKIA" + "A" * 16 + " and xoxb-" + "1" * 12), (2, "none"), (3, None)], "id int, text string")
    got = {r["id"]: (r["redacted"], r["counts"]) for r in text.redaction_counts(rows).collect()}
    assert got[1] == ("key [redacted] and [redacted]", {"aws_key_id": 1, "slack_token": 1}) and got[2] == ("none", {}) and got[3][0] is None


def test_negation_blocks_coupling(spark):
    c = spark.createDataFrame([(1, "The limit is 5000"), (2, "The limit is 5000"), (3, "the is"), (4, "It isn't live")], "claim_id int, text string")
    s = spark.createDataFrame([(1, "a limit of 5000 applies"), (2, "the limit was never 5000"), (3, "the is"), (4, "it isn't live yet")], "claim_id int, quoted_span string")
    assert {r["claim_id"]: r["coupled"] for r in claims.coupled(c, s).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_places_of_spans(spark):
    cases = [
        ("a b", "a b .. a  b", None, (0, 3)), ("a b", "a b .. a  b", 8, (7, 11)), ("a  c", "x a c", None, (2, 5)), ("", "x", None, None), ("x", None, None, None), (None, "x", 3, None),
        ("aa", "aaaa aa", 2, (2, 4)), (".*\\E(", "😀 .*\\E( x", None, (2, 7)), (" ", "a b", None, (1, 2)), ("no", "such", 1, None), ("b c", "b\u00a0c b c", 0, (0, 3)), ("ab", "ab", 5, (0, 2)),
    ]
    rows = spark.createDataFrame([(i, s, b, h) for i, (s, b, h, _) in enumerate(cases)], "i int, s string, b string, h int")
    got = {r["i"]: r["p"] and tuple(r["p"]) for r in rows.select("i", claims.span_place(F.col("s"), F.col("b"), F.col("h")).alias("p")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    bare = {r["i"]: r["p"] and tuple(r["p"]) for r in rows.filter("h is null").select("i", claims.span_place(F.col("s"), F.col("b")).alias("p")).collect()}
    assert bare == {i: c[3] for i, c in enumerate(cases) if c[2] is None}


def test_case_folding_couples(spark):
    c, s = spark.createDataFrame([(1, "STRASSE offen ΟΔΟΣ")], "claim_id int, text string"), spark.createDataFrame([(1, "Die Straße ist offen: οδος")], "claim_id int, quoted_span string")
    assert claims.coupled(c, s).first()["coupled"]


def test_a_long_chain_is_walked_whole(spark):
    n = 20_000
    versions = spark.range(n).select(F.concat(F.lit("v"), "id").alias("version_id"), F.lit("n").alias("note_id"), F.when(F.col("id") > 0, F.concat(F.lit("v"), F.col("id") - 1)).alias("parent_version_id"))
    got = state.history(spark.createDataFrame([("n", f"v{n - 1}")], "note_id string, head_version_id string"), versions)
    assert tuple(got.agg(F.count("*"), F.max("seq"), F.min("seq")).first()) == (n, n, 1)
    circle = spark.createDataFrame([("a", "n", "b"), ("b", "n", "a")], "version_id string, note_id string, parent_version_id string")
    with pytest.raises(ValueError, match="circle"):
        state.history(spark.createDataFrame([("n", "a")], "note_id string, head_version_id string"), circle)


def test_prefix_terms_of_any_number_of_lengths(spark):
    words = ["z" * n for n in range(1, 81)]
    index = search.build_index(spark.createDataFrame([(w, f"v{w}", w + "q") for w in words], "passage_id string, target_version string, text string"))
    queries = spark.createDataFrame([(len(w), w) for w in words], "query_id int, question string")
    found = search.starts_of(search.query_terms(queries, "prefix"), index.frequencies).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {n: 81 - n for n in range(1, 81)}


def test_golden_citations_must_be_known(spark):
    q, n = spark.createDataFrame([(1, "a?"), (2, "b?")], "item_id int, question string"), spark.createDataFrame([("n", "n.1")], "note_id string, head_version_id string")
    c = spark.createDataFrame([(1, 1, "n", "x"), (1, 2, "n", "y")], "item_id int, n int, note_id string, quoted_span string")
    assert {r["item_id"]: (r["relevant"], len(r["citations"])) for r in evaluate.load_golden(q, c, n).collect()} == {1: (["n.1"], 2), 2: ([], 0)}
    with pytest.raises(Exception, match="unknown note: m"):
        evaluate.load_golden(q, c.withColumn("note_id", F.lit("m")), n).collect()


def test_gate_abstains(spark):
    c = spark.createDataFrame([(1, 1, "cats purr"), (2, 2, "dogs bark loudly")], "answer_id int, claim_id int, text string")
    s = spark.createDataFrame([(1, 1, "t", "cats purr"), (2, 1, "t", "not there")], "claim_id int, n int, target_id string, quoted_span string")
    b = spark.createDataFrame([("t", "All cats\npurr and\ncats purr")], "target_id string, body string")
    rows, answers = claims.gate(c, s, b)
    assert {r["claim_id"]: r["survives"] for r in rows.collect()} == {1: True, 2: False}
    assert {r["answer_id"]: r["abstains"] for r in answers.collect()} == {1: False, 2: True}


def test_reach_upgrades_a_visited_node(spark):
    edges = spark.createDataFrame([("a", "b", "ai", "fresh"), ("a", "c", "ai", "fresh"), ("c", "b", "user", "fresh"), ("c", "d", "ai", "stale"), ("b", "a", "user", "fresh")], "from_id string, to_id string, source string, status string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, node string")
    assert {(r["node"], r["user"]) for r in context.reach(seeds, edges, 2).collect()} == {("b", 1), ("c", 0)}
    assert {(r["node"], r["user"]) for r in context.reach(seeds, edges, 1).collect()} == {("b", 0), ("c", 0)}
    assert context.reach(seeds, edges, 0).count() == 0


def test_age_labels(spark):
    rows = spark.createDataFrame([(30,), (60,), (7200,), (86400,), (15 * 86400,), (40 * 86400,), (800 * 86400,)], "s long")
    assert [r[0] for r in rows.select(context.age_label(F.col("s"))).collect()] == ["just now", "1 minute ago", "2 hours ago", "1 day ago", "2 weeks ago", "1 month ago", "2 years ago"]


def test_scope_rules_fail_closed(spark):
    e = spark.createDataFrame([("jira", "ABC-1"), ("jira", "ABCD-1"), ("web", "https://Docs.example.com/a"), ("wiki", "https://docs.example.com/a"), ("web", None)], "source_type string, external_id string")
    r = spark.createDataFrame([("jira", "ABC"), ("web", "docs.example.com"), ("wiki", "docs.example.com")], "source_type string, match string")
    assert {(x["source_type"], x["external_id"]): x["scoped"] for x in egress.scoped(e, r).collect()} == {("jira", "ABC-1"): True, ("jira", "ABCD-1"): False, ("web", "https://Docs.example.com/a"): True, ("wiki", "https://docs.example.com/a"): False, ("web", None): True}


def test_replace_by_key_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "target_version string, x int")
    new, keys = spark.createDataFrame([("b", 3), ("c", 4)], "target_version string, x int"), spark.createDataFrame([("b",), ("z",)], "target_version string")
    once = files.replace_by_key(old, new, keys)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, files.replace_by_key(once, new, keys).collect())) == [("a", 1), ("b", 3)]


@pytest.fixture
def keyed(spark, tmp_path):
    return KeyedTables(spark, f"{tmp_path}/index", {"rows": "target_version string, x int", "more": "target_version string, y int"}, buckets=4)


def _keys(spark, *found):
    return spark.createDataFrame([(k,) for k in found], "target_version string")


def _xs(spark, name, *rows):
    return spark.createDataFrame(list(rows), f"target_version string, {name} int")


def _held(keyed):
    return sorted(map(tuple, keyed.read("rows").collect())), sorted(map(tuple, keyed.read("more").collect()))


def test_keyed_tables_evict_and_stay_whole(spark, keyed):
    assert not keyed.exists() and _held(keyed) == ([], [])
    assert keyed.replace("one", _keys(spark, "a", "b", None), rows=_xs(spark, "x", ("a", 1), ("b", 2), ("other", 9), (None, 4)), more=_xs(spark, "y", ("a", 5)))
    assert keyed.exists() and _held(keyed) == ([("a", 1), ("b", 2)], [("a", 5)])
    before = keyed.read("rows")
    assert keyed.replace("two", _keys(spark, "a"))  # the last key of its bucket, without new rows
    assert _held(keyed) == ([("b", 2)], [])
    assert not keyed.replace("two", _keys(spark, "b")) and _held(keyed) == ([("b", 2)], [])  # done before
    assert keyed.replace("none", _keys(spark)) and not keyed.replace("none", _keys(spark, "b"))
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 2)]  # a reader stays with what it opened


def test_a_failing_writer_leaves_the_old_rows(spark, keyed):
    keyed.replace("one", _keys(spark, "a", "b"), rows=_xs(spark, "x", ("a", 1), ("b", 2)), more=_xs(spark, "y", ("b", 3)))
    broken = _xs(spark, "y", ("a", 7)).withColumn("y", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        keyed.replace("two", _keys(spark, "a", "b"), rows=_xs(spark, "x", ("a", 8)), more=broken)
    assert _held(keyed) == ([("a", 1), ("b", 2)], [("b", 3)])
    assert keyed.replace("two", _keys(spark, "a", "b"), rows=_xs(spark, "x", ("a", 8)), more=_xs(spark, "y", ("a", 7)))  # again, whole
    assert _held(keyed) == ([("a", 8)], [("a", 7)])
    assert keyed.vacuum() == ["one"] and _held(keyed) == ([("a", 8)], [("a", 7)])


def test_gate_audits_several_passages_of_a_target(spark):
    secret = "AKIA" + "A" * 16
    rows = [(1, 1, "a", f"{secret} {secret}", False), (1, 2, "b", "plain", False), (1, 3, "a", secret, False), (1, 4, "a", "plain", False), (1, 5, "c", secret, None), (2, 1, "b", "plain", False)]
    send, held, audit = egress.gate(spark.createDataFrame(rows, "batch_id int, ord int, target_id string, text string, no_egress boolean"))
    assert [r["target_id"] for r in held.collect()] == ["c"] and send.filter(F.contains("text", F.lit("AKIA"))).count() == 0
    got = {r["batch_id"]: (r["sent_targets"], r["redactions"]) for r in egress.audit_rows(audit, "qa", "m").collect()}
    assert got == {1: (["a", "b", "a", "a"], {"a": 1}), 2: (["b"], None)}  # of a target, the last passage with a secret counts


def test_bounded_search_finds_what_plain_search_finds(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(40_000)]
    rows = [(f"p{i}", f"v{i % 150}", " ".join(words[rng.randrange(39_000) :][: rng.randrange(1, 60)])) for i in range(900)]
    index = search.build_index(spark.createDataFrame(rows, "passage_id string, target_version string, text string"))
    queries = spark.createDataFrame([(i, " ".join(words[i * 50 : i * 50 + n])) for i, n in enumerate((1, 2, 5, 40, 400, 3, 0, 60))] + [(99, "unknown")], "query_id int, question string")
    live = spark.createDataFrame([(f"v{i}",) for i in range(0, 150, 2)], "target_version string")
    plain = search.top(search.bm25(search.query_terms(queries), index, live), 5, F.round("score", 9), F.col("passage_id"))
    want = sorted((r["query_id"], r["rank"], r["passage_id"], round(r["score"], 6)) for r in plain.collect())
    for seeds in (0, 30, 2000):
        monkeypatch.setattr(search, "SEED_POSTINGS", seeds)
        got = search.lexical_search(queries, index, 5, live)
        assert sorted((r["query_id"], r["rank"], r["passage_id"], round(r["score"], 6)) for r in got.collect()) == want


def test_classes_and_previews_of_hits(spark):
    passages = spark.createDataFrame([("p1", "t1", "red  apple\n" + "x" * 300), ("p2", "t2", "red pear"), ("p3", "t3", "apple")], "passage_id string, target_version string, text string")
    classes = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "b")], "target_version string, class string")
    queries = spark.createDataFrame([(1, "red apple", None), (2, "red apple", "b"), (3, "red apple", "c")], "query_id int, question string, class string")
    got = search.search_all_or_any(queries, search.build_index(passages), classes=classes, passages=passages).collect()
    assert {(r["query_id"], r["passage_id"], r["fallback"]) for r in got} == {(1, "p1", False), (2, "p2", True), (2, "p3", True)}
    shown = {r["passage_id"]: r["snippet"] for r in got}
    assert shown["p2"] == "red pear" and shown["p1"] == "red apple " + "x" * 230 + "..."


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        (None, ""), ("", ""), ("a &lt;b&gt; &amp;amp; c&nbsp;d &#233;&eacute;", "a <b> &amp; c d éé"), ("<p>one</p><p>two", "one two"), ("x<script>if (a < b) '</p>'</script>y", "x y"), ("x<SCRIPT >a</script foo>y", "x y"),
        ("x<!-- a > b -->y<!-->z<!--->w", "x y z w"), ("a<img alt='>' title=\"<\">b", "a b"), ("1 < 2 <3", "1 < 2 <3"), ("a<!doctype x>b<?php c?>d</ >e", "a b d e"), ("<title>T</title>b<style>p{}", "b"), ("a<b c=\"d>e", "a e"), ("x<!-- never", "x"), ("İ<script>İ</script>ß", "İ ß"),
    ],
)
def test_visible_text(page, shown):
    assert visible_text(page) == shown


def test_a_reference_ends_with_a_semicolon():
    assert visible_text("<h1>ver&amp;&amp</h1><p>und&ampund &copy2 &#65 &lt;") == "ver&&amp und&ampund &copy2 &#65 <"
    assert visible_text("&amp;lt; &ampx; &nosuch; &#x41;&#X42;&hellip; &; &#; &") == "&lt; &ampx; &nosuch; AB… &; &#; &"


def test_visible_text_reads_a_page_once():
    import time

    for part in ("<a b='", "<script>", "<!--", "<div>x ", "</", "<!", "<a \"", "&amp;"):
        began = time.perf_counter()
        visible_text(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 5, part


def _entries(seed):
    """An edit log with every kind of entry, among them parents that are stale, unknown or of other branches."""
    import random

    rng = random.Random(seed)
    rows = []
    for note in range(12):
        heads, ids, bodies = None, [""], ["one", "two", "", "three"]
        for seq in range(1, 26):
            action = rng.choice(["save", "save", "save", "delete", "recover", "other"])
            body = rng.choice(bodies)
            parent = rng.choice(["@head", "@head", "@head", rng.choice(ids), "nowhere", None])
            rows.append((f"n{note}", seq, action, body if action == "save" else None, parent))
            if action == "save":
                heads = content_key(f"n{note}", heads or "", body)
                ids.append(heads)
    return rows


def test_streamed_edit_log_agrees_with_replay(spark, tmp_path):
    kind = "note_id string, seq long, action string, body string, parent string"
    rows = _entries(5)
    for k in range(3):  # three batches
        spark.createDataFrame([r for r in rows if (r[1] - 1) // 9 == k], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/log")
        got = jobs.drained(jobs.edit_log(stream), f"{tmp_path}/out")
    columns = ["note_id", "seq", "action", "outcome", "version_id", "head_id"]
    want = state.replay(spark.createDataFrame(rows, kind)).select(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r["outcome"] for r in want.collect()} == {"created", "updated", "noop", "deleted", "recovered", "conflict", "unknown"}


def test_streamed_tombstones_come_late(spark, tmp_path):
    kind = "external_id string, seq long, body string, status string, fetched_at timestamp"
    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    batches = [
        [("e", 1, "A", "ok", at(10)), ("e", 2, "gone", "tombstone", at(5)), ("f", 1, "gone", "tombstone", at(5))],
        [("e", 3, "gone", "tombstone", at(9)), ("e", 4, "A", "ok", at(8)), ("e", 5, "gone", "tombstone", at(20)), ("f", 2, "B", "ok", at(1))],
        [("e", 6, "gone", "tombstone", at(3)), ("e", 7, "A", "ok", at(30)), ("e", 8, "gone", "tombstone", at(30)), ("f", 3, None, "ok", at(2)), ("f", 4, "B", "ok", at(3))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        got = jobs.drained(jobs.ingest_snapshots(spark.readStream.schema(kind).parquet(f"{tmp_path}/log")), f"{tmp_path}/out")
    out = {(r["external_id"], r["seq"]): r["outcome"] for r in got.collect()}
    assert [out["e", i] for i in range(1, 9)] == ["new", "late", "late", "same", "new", "same", "seen", "late"]
    assert [out["f", i] for i in range(1, 5)] == ["new", "new", "new", "seen"]


def test_streamed_counts_show_open_windows(spark, tmp_path):
    kind = "ts timestamp, type string"
    hour = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for rows in ([(hour(1), "a"), (hour(1, 59), "a"), (hour(3), None)], [(hour(3, 1), None), (hour(2, 30), "b")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        got = jobs.upserted(jobs.event_counts(spark.readStream.schema(kind).parquet(f"{tmp_path}/log"), "type"), ("start", "type"), f"{tmp_path}/out")
    assert {(r["start"].hour, r["type"]): r["n"] for r in got.collect()} == {(1, "a"): 2, (3, None): 2, (2, "b"): 1}


def test_corpus_and_log_loaders(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a note.md").write_text("# A\nzwölf")
    (tmp_path / "docs" / "b.txt").write_text("no")
    assert [tuple(r) for r in files.load_corpus(spark, f"{tmp_path}/docs").collect()] == [("a note", "# A\nzwölf")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.jsonl").write_text('{"q": "a", "n": 1}\n\nnot json\n{"q": "b", "n": 0}\n')
    assert sorted(r["q"] for r in files.load_log(spark, f"{tmp_path}/log", T.StructType.fromDDL("q string, n int")).collect()) == ["a", "b"]


def test_ledger_keys_fold_null_prompts(spark):
    ledger = spark.createDataFrame([(1, "embed", "t", None, "failed"), (2, "embed", "u", "v", "done")], "id int, type string, target_version string, prompt_ver string, status string")
    asked = spark.createDataFrame([("embed", "t", ""), ("embed", "u", "v"), ("embed", "u", "v")], "type string, target_version string, prompt_ver string")
    assert [tuple(r) for r in gaps.append_requests(ledger, asked).collect()] == [("embed", "u", "v")]


def test_refresh_bound_is_inclusive(spark):
    now = dt.datetime(2024, 1, 1, 1, 0, 0)
    e = spark.createDataFrame([("a", "s1"), ("b", "s2")], "external_id string, head_snapshot_id string")
    s = spark.createDataFrame([("s1", "ok", dt.datetime(2024, 1, 1)), ("s2", "ok", dt.datetime(2024, 1, 1, 0, 0, 1))], "snapshot_id string, status string, fetched_at timestamp")
    jobs = spark.createDataFrame([], "type string, status string, target_version string")
    assert [r[0] for r in gaps.refresh_due(e, s, jobs, F.lit(now)).collect()] == ["a"]


def test_knn_skips_odd_vectors(spark):
    v = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [0.0, 0.0]), ("c", "t", [1.0]), ("d", "t", [1.0, 1.0]), ("e", "t", None)], "passage_id string, target_version string, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id int, vector array<float>")
    assert [(r["query_id"], r["passage_id"]) for r in search.knn(q, v, 5).orderBy("query_id", "rank").collect()] == [(1, "a"), (1, "d")]
    assert search.knn(q.filter("query_id = 9"), v, 5).count() == 0


def test_knn_leaves_far_cells_out(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 12))
    held = [(f"p{i}", f"t{i % 3}", (centres[i % 20] + 0.05 * rng.normal(size=12)).tolist()) for i in range(2000)] + [("z", "t0", [0.0] * 12), ("short", "t0", [1.0, 2.0]), ("inf", "t0", [float("inf")] * 12)]
    asked = [(i, (centres[i % 20] + 0.05 * rng.normal(size=12)).tolist()) for i in range(40)] + [(90, rng.normal(size=12).tolist()), (91, [1.0, 1.9]), (92, [0.0] * 12), (93, [1.0] * 5)]
    vectors, queries = spark.createDataFrame(held, "passage_id string, target_version string, vector array<double>"), spark.createDataFrame(asked, "query_id int, vector array<double>")
    monkeypatch.setattr(search, "BLOCK_VECTORS", 37)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 5)
    found, counts = search.knn_with_counts(queries, vectors, 5, cell_vectors=60)
    want = {}
    for q, v in asked:
        near = [(round(1 - float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), 9), p) for p, _, x in held if len(x) == len(v) and np.linalg.norm(v) and np.isfinite(np.linalg.norm(x)) and np.linalg.norm(x)]
        want[q] = [p for _, p in sorted(near)[:5]]
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["passage_id"])
    assert got == {q: p for q, p in want.items() if p}
    row = counts.first()
    assert 0 < row["compared"] < row["all_pairs"] / 4


def test_backfill_moves_links(spark):
    edges = spark.createDataFrame([(1, "old", "user", "https://acme.atlassian.net/browse/AB-1"), (2, "https://e.org/", "user", "https://E.org")], "id int, to_id string, source string, quoted_text string")
    ext = spark.createDataFrame([("https://e.org/", "s")], "external_id string, head_snapshot_id string")
    snaps = spark.createDataFrame([("s", "tombstone")], "snapshot_id string, status string")
    out = links.backfill(edges, ext, snaps)
    assert [r["external_id"] for r in out["mint"].collect()] == ["AB-1"] and [r["id"] for r in out["repoint"].collect()] == [1] and [r[0] for r in out["refresh"].collect()] == ["AB-1"]


def test_user_rows_keep_values_away(spark):
    kind = "id long, target string, source_version string, kind string, payload string, source string, status string"
    old = spark.createDataFrame([(1, "n", "v1", "tag", "x", "ai", "fresh"), (2, "n", None, "tag", "y", "user", "orphaned")], kind)
    new = spark.createDataFrame([("n", "v1", "tag", "y"), ("n", "v1", "tag", "z")], "target string, source_version string, kind string, payload string")
    assert sorted((r["payload"], r["source"]) for r in annotations.load_enrichment(old, new).collect()) == [("y", "user"), ("z", "ai")]


def test_a_long_section_is_not_copied_for_each_passage(spark, monkeypatch):
    """Passages leave a worker in batches of bounded size, and parents "first" gives each section once."""
    words = " ".join(f"w{i}" for i in range(3000))
    rows = [("a", f"intro\n# H\n{words}\n- item\n# Last"), ("b", None), ("c", "one"), ("d", "# T\nx")]
    bodies = spark.createDataFrame(rows, "target_version string, body string").coalesce(1)
    monkeypatch.setattr(text, "BATCH_CHARS", 1000)
    each = {r["passage_id"]: r for r in text.chunk(bodies, 64, 8).collect()}
    want = {f"{k}:{p[0]}": p for k, body in rows for p in passages.passages(body, 64, 8)}
    assert {k: (r["ord"], r["char_start"], r["char_end"], r["text"], r["parent_block"]) for k, r in each.items()} == want
    first = {r["passage_id"]: r for r in text.chunk(bodies, 64, 8, parents="first").collect()}
    assert sum(len(r["section_text"] or "") for r in first.values()) < sum(len(b or "") for _, b in rows)
    for k, r in first.items():
        head = first[f"{r['target_version']}:{r['section']}"]
        assert (head["section_text"] or head["text"]) == each[k]["parent_block"] and (r["section_text"] is None or r["ord"] == r["section"])
    assert "parent_block" not in text.chunk(bodies, parents=None).columns


def test_an_index_holds_each_section_once(spark, tmp_path):
    """What is stored grows with the body, not with the square of a section's passages; built in place or by replacing, it is the same."""
    body = "\n\n".join(f"line {i} of one section with word{i % 7} and word{i % 7}" for i in range(400))
    bodies = spark.createDataFrame([("a.1", body), ("b.1", "# H\none"), ("c.1", ""), ("d.1", None), (None, "lost")], "target_version string, body string")
    tables = search.index_folder(spark, f"{tmp_path}/index")
    assert tables.rebuild("all", bodies, search.index_bodies) and not tables.rebuild("all", bodies, search.index_bodies)
    found, index = search.open_index(tables)
    stored = found.filter("target_version = 'a.1'").selectExpr("sum(length(text) + coalesce(length(section_text), 0))").first()[0]
    assert found.count() == 402 and stored < 2.1 * len(body)
    assert {tuple(r) for r in index.postings.filter("passage_id = 'a.1:8'").select("term", "length", "tf").collect()} == {(w, 9, n) for w, n in (("line", 1), ("8", 1), ("of", 1), ("one", 1), ("section", 1), ("with", 1), ("and", 1), ("word1", 2))}
    hits = spark.createDataFrame([(1, "a.1:8", "a.1"), (1, "a.1:9", "a.1"), (2, "b.1:1", "b.1"), (3, "z", "z")], "query_id int, passage_id string, target_version string")
    wide = {r["passage_id"]: (r["text"], r["parent_block"]) for r in search.expand(hits, found, parents=True).collect()}
    assert wide == {"a.1:8": (body.split("\n\n")[8], body), "a.1:9": (body.split("\n\n")[9], body), "b.1:1": ("one", "# H\none")}
    other = search.index_folder(spark, f"{tmp_path}/other")
    other.replace("all", bodies, **search.index_bodies(bodies))
    assert sorted(map(str, found.collect())) == sorted(map(str, search.open_index(other)[0].collect()))
    assert tables.rebuild("next", spark.createDataFrame([("a.1", "new"), ("e.1", "more")], bodies.schema), search.index_bodies)  # old rows go, neighbours stay
    assert sorted(r["passage_id"] for r in search.open_index(tables)[0].collect()) == ["a.1:0", "b.1:0", "b.1:1", "e.1:0"]


def _pairs_of_words(spark, seed, passages_, queries_):
    import random

    rng = random.Random(seed)
    text_ = lambda most: " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(most)))
    rows = [(f"p{i}", f"v{i % 90}", text_(25)) for i in range(passages_)]
    rows += [(f"q{i}", f"v{i % 90}", "w1 w2 w3 tie") for i in range(60)]  # equal scores
    asked = [(f"a{i}", text_(120)) for i in range(queries_)] + [("tied", "tie w2"), ("none", "unknown")]
    return spark.createDataFrame(rows, "passage_id string, target_version string, text string").repartition(3), spark.createDataFrame(asked, "query_id string, question string")


def test_long_queries_by_segments_and_blocks_are_exact(spark, monkeypatch):
    """All scores, whatever the sizes of segments, blocks, slices and pieces, with ties in order."""
    rows, queries = _pairs_of_words(spark, 5, 700, 40)
    index = search.build_index(rows)
    live = F.regexp_extract("target_version", r"(\d+)", 1).cast("int") % 3 != 0
    plain = search.bm25(search.query_terms(queries), index).filter(live)
    order = lambda df: sorted((r["query_id"], r["rank"], r["passage_id"], round(r["score"], 6)) for r in df.collect())
    want = order(search.top(plain, 12, F.round("score", 9), F.col("passage_id")))
    assert order(search.lexical_search(queries, index, 12, live)) == want
    from tessera.operators import segments

    for name, value in (("SEGMENT_PASSAGES", 50), ("SLICE_ROWS", 20), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(segments, name, value)
    assert order(search.lexical_search(queries, index, 12, live)) == want
    asked = search.query_terms(queries).join(index.frequencies, "term").select("query_id", "term", F.col("times").cast("double").alias("weight"))
    pieces = [tuple(map(bytes, r)) for r in segments.segments(index.rows).collect()]
    blocks = [segments._Block.of(*map(bytes, r[1:])) for r in segments.blocks(asked)[0].collect()]
    assert len(pieces) > 9 and len(blocks) > 4

    def all_best():  # as a worker does, with sizes of its own
        out = {}
        for block in blocks:
            floor = np.full(len(block.ids), -np.inf)
            for piece in pieces:
                found, floor = segments._search(piece[:2], segments._known(segments._unpacked(piece[2]).column(0), block), block, floor, 12, 11.0, 1.2, 0.75, 30)
                for r in found.to_pylist() if found is not None else ():
                    out.setdefault(r["query_id"], []).append((round(r["score"], 9), r["passage_id"]))
        return {q: sorted(rows_)[:12] for q, rows_ in out.items()}

    base = all_best()
    for name, value in (("CELLS", 300), ("FREQUENT_CELLS", 64), ("PAIR_COST", 0), ("PAIR_COST", 1e9)):  # pair by pair; all as columns
        monkeypatch.setattr(segments, name, value)
        assert all_best() == base


def test_no_posting_is_shuffled_for_a_search(spark, monkeypatch):
    """Of all passages that match, only the best of each task are dealt out, by their query."""
    rows, queries = _pairs_of_words(spark, 6, 300, 10)
    index = search.build_index(rows)
    heads = spark.createDataFrame([(f"n{i}", f"v{i}") for i in range(0, 90, 2)], "note_id string, head_version_id string")
    even = F.regexp_extract("target_version", r"(\d+)", 1).cast("int") % 2 == 0
    from tessera.operators import segments

    stored = []
    monkeypatch.setattr(segments, "written", lambda df, label: stored.append((label, df)) or written(df, label))
    search.lexical_search(queries, index, 3, even)
    search.prefix_search(queries, index, heads, 3, even)
    plans = [df._jdf.queryExecution().sparkPlan().toString().split("\n") for label, df in stored if label == "best-passages"]
    moved = [[line for line in plan if "Join" in line or "Aggregate" in line or "Cartesian" in line] for plan in plans]
    assert len(moved) == 2 and all("CartesianProduct" in m[0] or "BroadcastNestedLoopJoin" in m[0] for m in moved), moved
    assert not moved[0][1:] and all("BroadcastHashJoin" in line for line in moved[1][1:]), moved  # segments with their frequencies
    assert sum(df.count() for label, df in stored if label == "query-blocks") == 2 and sum(len(b["weights"]) for label, df in stored if label == "query-blocks" for b in df.collect()) < 20_000
    starts = search.starts_of(search.query_terms(queries, "prefix"), index.frequencies).groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    live = heads.select("note_id", F.col("head_version_id").alias("target_version"))
    best = search.top(search.bm25(starts, index, live), 7, F.round("score", 9), F.col("passage_id")).join(live, "target_version").groupBy("query_id", "note_id").agg(F.min("rank").alias("best")).collect()
    for kind in (None, even):
        got = search.prefix_search(queries, index, heads, 7, kind).collect()
        assert {(r["query_id"], r["note_id"]) for r in got} == {(r["query_id"], r["note_id"]) for r in best}
