"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, bpe, components, decontamination, html_text, language_id, near_dedup, quality, token_files, url_filter, warc
from tests.oracle import plain, spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, verdict string"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog in the yard today.", "en", "a", 60),
    (2, "the CAT sat on the mat\nand looked at the dog in the yard today.", "en", "a", 60),
    (2, "the CAT sat on the mat\nand looked at the dog in the yard today.", "en", "a", 60),
    (3, None, "en", None, None), (4, "", None, "b", 0), (5, " \n\t ", "de", "b", 4), (6, "12345 !!", "en", None, 8), (7, LONG, "en", "c", None), (8, LONG + " end", None, "c", -1),
    (None, "A text without an id, but with words.", "en", "a", 36), (9, "Der Hund und die Katze sitzen auf der Matte und sehen in den Garten.", "de", "a", 66), (10, "two words", "en", "a", 9), (11, "two words", "en", "b", 9),
    (12, "<|endoftext|> x<|endoftext|>", "en", "a", 10), (13, "naïve café — ‘déjà vu’ 中文 😀  double  space\r\n\r\nend ", "fr", "a", 40), (14, "a" * 3000, "en", "a", 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_agrees_with_the_library(spark, docs, nothing):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    got = {(r["doc_id"], r["text"]): r for r in bpe.decoded(bpe.encoded(docs)).collect()}
    for (_, text), r in got.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == (text or "")
    digests = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    assert digests[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == digests[4]["decoded_sha256"]
    assert bpe.digests(docs).count() == len(ROWS) and bpe.encoded(nothing).count() == 0


def test_bpe_of_every_token_and_of_odd_text():
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    found = codec.encode_words(codec.ids)
    assert all(np.frombuffer(found[piece], "<u4").tolist() == [i] for piece, i in codec.ids.items())
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'ll", "é", "中文", "😀", "a", "The", "123", "...", "\x1c", "\xa0", "\u2003", "----", "\x00", "²", "_", "\u200b"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(800)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_of_long_texts_without_spaces():
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = np.random.default_rng(5)
    texts = ["a" * 240_000, "".join(rng.choice(list("etaoinshrdlu"), 240_000)), "ab" * 120_000, "中文" * 60_000]
    began = time.perf_counter()
    found = codec.encode(texts)
    took = time.perf_counter() - began
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids and codec.decode(ids) == text
    assert took < 60


def test_token_files_round_trip(spark, docs, nothing, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    token_files.write(docs, f"{tmp_path}/t")
    got = token_files.read(spark, f"{tmp_path}/t").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, r in zip(order, sorted(got, key=lambda r: r["start"]), strict=True):
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["token_ids"]) == (row[0], start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_files.write(nothing, f"{tmp_path}/n")
    assert token_files.read(spark, f"{tmp_path}/n").count() == 0


def test_token_ids_of_odd_text():
    encoder = token_files.encoder(public_tokenizers.path(token_files.VOCABULARY))
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "é", "É", "e\u0301", "中文", "😀", "a", "The", "ß", "İ", "ı", "ÿ", "Ÿ", "×", "123", "...", ".,", ",", "\x1c", "\x85", "\xa0", "\u2003", "--", "\x00", "²", "ª", "_", "\u200b", "<|endoftext|>", "µ", "Ω"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)]
    for some in (texts[:1], texts[1:700], [None, "", *texts[700:]]):
        ids, counts = encoder.encode(some)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for k, text in enumerate(some):
            assert ids[edges[k] : edges[k + 1]].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_codes_are_short_prefix_free_and_near_the_entropy():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765, 10946, 17711], np.int64)
    for longest in (5, 8, 18):
        lengths = token_files.code_lengths(counts, longest)
        assert lengths[0] == 0 and lengths[1:].max() <= longest
        assert sum(2.0 ** -int(n) for n in lengths[1:]) == 1.0
    p = counts[1:] / counts.sum()
    assert (p * lengths[1:]).sum() <= -(p * np.log2(p)).sum() + 1
    ids = np.random.default_rng(2).choice(len(counts), 5000, p=counts / counts.sum())
    counts = np.array([0, 1, 3000, 0, 127, 128, 129, 1615, 0])
    bits, starts, marks = token_files.pack(ids, counts, lengths, token_files.codes(lengths))
    got = token_files.unpack(bits, starts, counts, marks, token_files.reading_table(lengths))
    assert [len(x) for x in got] == counts.tolist() and (np.concatenate(got) == ids).all()
    assert token_files.code_lengths(np.array([0, 7]), 18).tolist() == [0, 1]


def test_near_duplicates_against_sql(spark, sf_dir):
    assert spark_rows(near_dedup.op10_near_dedup(spark, sf_dir)) == sql_rows(sf_dir, near_dedup.ORACLE)


def test_near_duplicates_of_odd_rows(spark, docs, nothing):
    got = {(r["doc_id"], r["text"]): r for r in near_dedup.near_duplicates(docs).collect()}
    by = {k[0]: (r["component_id"], r["n_shingles"]) for k, r in got.items()}
    assert by[1] == by[2] == (1, 11) and by[10] == (10, 1) and by[11] == (10, 1) and by[8][0] == 7
    assert by[3] == (3, 0) and by[4] == (4, 0) and by[5] == (5, 0) and by[None][0] is None
    kept = sorted(r["doc_id"] or 0 for r in near_dedup.near_duplicates(docs).filter("kept").collect())
    assert kept == [0, 1, 3, 4, 5, 6, 7, 9, 10, 12, 13, 14]
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_crowded_regions_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION_ROWS", 8)
    words = [f"w{i}" for i in range(120)]
    rows = [(100 + i, " ".join(w if j != 7 + i else "x" for j, w in enumerate(words))) for i in range(40)] + [(1, " ".join(f"y{i}" for i in range(50)))]
    found = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.filter("doc_id >= 100").collect()} == {100}
    reps = spark.createDataFrame([(i, "same", 0) for i in range(50)], "rep long, region_name string, place int").select("rep", "place", F.xxhash64("region_name").alias("region"))
    runs = near_dedup._in_runs(reps)
    assert runs.groupBy("region").count().agg(F.max("count")).first()[0] <= 20 and runs.filter("rep = 0").count() == runs.select("region").distinct().count()


def test_pairs_in_a_template_are_linked_however_crowded(spark, monkeypatch):
    """All texts share three quarters of their words; the pairs planted among them are links, the others are not."""
    monkeypatch.setattr(near_dedup, "REGION_ROWS", 64)
    rng = np.random.default_rng(12)
    shared = [f"s{x}" for x in range(300)]
    rows = []
    for i in range(900):
        own = [f"x{x}" for x in rng.integers(0, 10**9, 100)]
        rows += [(len(rows), " ".join(shared + own))]
        if i % 4 == 0:
            rows += [(len(rows), " ".join(shared + own[:64] + [f"y{x}" for x in rng.integers(0, 10**9, 36)]))]
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r["doc_id"] != r["component_id"] for r in got) == 225 and all(r["doc_id"] - r["component_id"] in (0, 1) for r in got)


def test_the_runs_of_a_crowded_region_stay_tied(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION_ROWS", 4)
    words = [f"w{i}" for i in range(120)]
    rows = [(100 + i, " ".join(w if j != 7 + i else "x" for j, w in enumerate(words))) for i in range(80)]
    same = F.lit(bytes(4 * near_dedup.SLOTS))
    features = near_dedup._features
    monkeypatch.setattr(near_dedup, "_features", lambda c: (lambda f: F.struct(f["n_shingles"].alias("n_shingles"), f["digest"].alias("digest"), same.alias("signature")))(features(c)))
    found = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {100}


def test_many_variants_of_a_text_stay_one_group(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(6000):
        at = int(rng.integers(400))
        rows.append((i, " ".join([*words[:at], f"x{i}", *words[at + 1 :]])))
    found = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert found.select("component_id").distinct().count() == 1


def test_blocks_of_a_region_keep_every_candidate(monkeypatch):
    rng = np.random.default_rng(3)
    slots = np.where(rng.random((60, near_dedup.SLOTS)) < 0.2, rng.integers(0, 9, (60, near_dedup.SLOTS)), 7).astype(">u4")
    n = rng.integers(80, 100, 60)
    members = pd.DataFrame({"rep": range(100, 160), "place": 0, "region": 5, "n_shingles": n, "signature": [x.tobytes() for x in slots], "regions": [np.array([5] * 16)] * 60})

    def pairs():
        rows = pd.concat(near_dedup._candidates(iter([members[:25], members[25:]])))
        text = dict(zip(members["rep"], n, strict=True))
        assert all(sum(text[d] for d in own["rep"]) <= 2 * (near_dedup.BLOCK_SHINGLES + 100) for _, own in rows.groupby("region"))
        for _, own in rows.groupby("region"):
            assert own["rep"].is_unique and {p for ps in own["partners"] for p in ps} <= set(own["rep"])
        found = [(r.rep, p) for r in rows.itertuples() for p in r.partners]
        assert len(found) == len(set(found))
        return rows["region"].nunique(), set(found)

    whole = pairs()
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    parted = pairs()
    assert whole[0] == 1 and parted[0] > 10 and whole[1] == parted[1] and len(whole[1]) > 500


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {(r["component"], r["node"] >= 100) for r in components.connected_components(edges, "a", "b").collect()} == {(1, False), (100, True)}


def test_decontamination_against_sql(spark, sf_dir):
    assert spark_rows(decontamination.op9_decontamination(spark, sf_dir)) == sql_rows(sf_dir, decontamination.ORACLE)


def test_decontamination_tolerates_substitutions(spark, docs, nothing):
    item = [f"t{i}" for i in range(16)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "quite a short item"), (3, None), (None, " ".join(item)), (4, " ,"), (5, "")], "item_id long, text string")
    rows = [(0, "x " + " ".join(item).upper() + ", y")]
    rows += [(10 * a + b, " ".join("z" if i in (a, b) else w for i, w in enumerate(item[:13]))) for a in range(1, 13) for b in range(a)]
    clean = [(1001, " ".join("z" if i in (2, 6, 10) else w for i, w in enumerate(item[:13]))), (1002, " ".join(item[:10])), (1003, "quite a short"), (1004, "quite a tall item"), (1005, None), (1006, "")]
    rows += [(1010, "before, Quite a short item!"), (1011, "filler " * 30_000 + " ".join(item))]
    found = decontamination.contaminated(spark.createDataFrame(rows + clean, "doc_id long, text string"), benchmark)
    assert {r["doc_id"] for r in found.collect()} == {r[0] for r in rows}
    assert decontamination.decontaminate(docs, benchmark).count() == len(ROWS) and decontamination.contaminated(docs, benchmark.filter("item_id > 3")).count() == 0
    assert decontamination.contaminated(nothing, benchmark).count() == 0 and decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_no_tolerated_difference_is_missed(spark, tmp_path):
    """Items of 1 to 16 tokens, every set of up to three substitutions in each: Spark finds just what the SQL does."""
    items = [(n, [f"i{n}t{k}" for k in range(n)]) for n in range(1, 17)]
    docs, changed = [], {}
    for n, item in items:
        for size in range(min(n, 4)):
            for places in combinations(range(n), size):
                changed[len(docs)] = (n, places)
                docs.append((len(docs), " ".join(["before", *("z" if k in places else w for k, w in enumerate(item)), "after"])))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in items], "item_id long, text string")
    found = decontamination.contaminated(docs.withColumn("item_id", F.lit(-1)), benchmark.withColumn("doc_id", F.lit(-1)))
    expected = set()
    for doc, (n, places) in changed.items():
        width = min(n, 13)
        least = 11 if n >= 13 else n - n * 2 // 13
        if any(width - sum(s <= p < s + width for p in places) >= least for s in range(n - width + 1)):
            expected.add((doc, n))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    for name, frame in (("documents", docs), ("benchmark", benchmark)):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        os.rename(next(str(x) for x in (tmp_path / name).glob("*.parquet")), f"{tmp_path}/{name}.parquet")
        shutil.rmtree(tmp_path / name)
    assert spark_rows(found) == sql_rows(str(tmp_path), decontamination.ORACLE)


def test_language_held_out_accuracy(spark, sf_dir):
    found = language_id.op8_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.collect())


def test_language_of_odd_rows(spark, docs, nothing):
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs).collect()}
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {3, 4, 5, 6} and got[3]["score"] == 0
    assert language_id.identify_languages(docs).count() == len(ROWS) and language_id.identify_languages(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_tells_good_from_bad(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.op3_quality(spark, sf_dir).join(labels, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) >= 0.9 * len(rows)


def test_quality_leaves_out_toxic_documents(spark):
    rng = np.random.default_rng(5)
    common = [f"{a}{b}ing" for a in "bcdfgklm" for b in ("al", "er", "on", "ut")]
    rows = []
    for i in range(600):
        words = [common[k] for k in rng.integers(len(common), size=40)]
        if i % 5 == 0:
            words[7] = words[23] = ("vile", "filth")[i % 2]
        rows.append((i, " ".join(words), "en", "a", 200))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.classify_quality(docs, labels).filter("keep").collect()}
    toxic = {i for i in range(400, 600) if i % 5 == 0}
    clean = set(range(400, 600)) - toxic
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept & clean) >= 0.95 * len(clean)


def test_quality_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (14, 0, 1), (9, 1, None), (10, 1, 0), (12, 0, 0), (None, 1, 0), (13, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify_quality(docs, labels)
    assert out.count() == len(ROWS) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify_quality(docs, labels.limit(0)).filter("keep and score is null").count() == len(ROWS)
    assert quality.classify_quality(nothing, labels).count() == 0


def test_neighbours_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = total = 0
    found: dict[int, list] = {}
    for r in ann.op2_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r)
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        true = set(ids[np.lexsort((ids, distance))[:10]].tolist())
        own = found[int(ids[q])]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r["score"] - distance[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-9 for r in own)
        hits, total = hits + len(true & {r["vec_id"] for r in own}), total + 10
    assert hits >= 0.9 * total


def test_neighbours_recall_among_many_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 48))
    x = (centres[rng.integers(200, size=20_000)] + 0.35 * rng.normal(size=(20_000, 48))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(8)
    found: dict[int, dict] = {}
    for r in ann.nearest_neighbours(rows).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    exact, hits = x.astype(np.float64), 0
    for q in range(0, 20_000, 100):
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        distance[q] = np.inf
        hits += len(set(np.argsort(distance, kind="stable")[:10].tolist()) & found[q].keys())
        assert len(found[q]) == 10 and all(abs(s - distance[v]) < 1e-12 for v, s in found[q].items())
    assert len(found) == 200 and hits >= 0.9 * 2000


def test_neighbours_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, score int"
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 3.0]), (None, [1.0, 0.0]), (200, [0.0, 3.0]), (300, None)]
    rows += [(1000 + i, [5.0, 5.0]) for i in range(40) if (1000 + i) % 100]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(spark.createDataFrame([(*r, 0, 0) for r in rows], kind)).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 100] == [1, 7, 200, *range(1001, 1008)] and got[10] == (200, 1, 7) and {g[0] for g in got} == {100, 200}
    assert ann.nearest_neighbours(spark.createDataFrame([], kind)).count() == 0


def test_given_url_rules(spark):
    urls = [
        ("https://a.Example.NET/en/x?y#z", "example.net/en/", "allow"), ("http://example.net/de/", "net/", "block"), ("http://example.net", None, "allow"), ("x://www.example.com/de/1", "example.com/de/", "block"),
        ("http://notexample.com/de/1", None, "allow"), ("https://q.org/fr/?a=/en/", "org/fr/", "allow"), ("no scheme/en/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("ftp://net/", "net/", "block"),
        ("https://example.net/en/" + "long/" * 100_000, "example.net/en/", "allow"), ("https://" + "a." * 2_000 + "example.com/de/", "example.com/de/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, (u, _, _) in enumerate(urls)] + [(0, urls[0][0], "x", "clash")], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter.judge_urls(pages, labels).collect()
    assert len(got) == len(urls) + 1 and all((r["rule"], r["verdict"]) == urls[r["page_id"]][1:] for r in got)
    first = next(r for r in got if r["page_id"] == 0)
    assert (first["host"], first["path"]) == ("a.example.net", "/en/x") and url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_url_rules_block_what_labels_foretell(spark):
    urls = [f"https://{'spam-farm' if i % 4 == 0 else 'news'}.example.com/{'win' if i % 8 == 0 else 'read'}/{i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 400)] + [(None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert all((r["verdict"] == "block") == (i % 4 == 0) and r["rule"] is None for i, r in got.items())
    assert set(got[0]["mined"].split()) <= {"domain=example.com", "word=spam", "word=farm", "word=com", "word=example", "path=win"}


def test_many_parts_that_urls_share_are_mined_at_once(spark):
    shop = "/".join(f"part{k}x" for k in range(20))
    urls = [f"https://shop.example.com/{shop}/item{i}" if i % 50 == 0 else f"https://news{i % 7}.example.org/read/{i}" for i in range(2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 50 == 0 else 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    began = time.perf_counter()
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, labels).collect()}
    assert time.perf_counter() - began < 60 and all((v == "block") == (i % 50 == 0) for i, v in got.items())


def test_mined_rules_are_those_of_all_combinations(spark):
    rng = np.random.default_rng(11)
    parts = [f"w{chr(97 + k)}" for k in range(6)]
    rows, bad = [], {}
    for i in range(300):
        chosen = [p for p in parts if rng.random() < 0.4]
        rows.append((i, f"https://h{i % 3}.example/{'/'.join(chosen)}/twin/pair/{i}"))
        bad[i] = int(rng.random() < (0.9 if {"wa", "wb"} <= set(chosen) else 0.8 if "we" in chosen and i % 3 == 0 else 0.15))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    items = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", url_filter.url_tokens(F.col("url")).alias("t")).collect()}
    support, share = max(0.02 * 300, 8), sum(bad.values()) / 300
    held = {t: frozenset(i for i in items if t in items[i]) for t in set().union(*items.values())}
    first = {t: min(u for u in held if held[u] == held[t]) for t in held}
    usable = sorted({first[t] for t in held if sum(bad[i] for i in held[t]) >= support})
    rules = {}
    for size in range(1, len(usable) + 1):
        level = {}
        for combo in combinations(usable, size):
            where = frozenset.intersection(*(held[t] for t in combo))
            hits = sum(bad[i] for i in where)
            if hits >= support and hits / len(where) >= 0.5 and hits / len(where) / share >= 1.5:
                level[combo] = hits / len(where)
        rules |= level
    kept = {c: v for c, v in rules.items() if not any(set(s) < set(c) and rules[s] >= v for s in rules)}
    got = {tuple(sorted(r["rule_tokens"])): r["confidence"] for r in url_filter.mine(pages, labels, 0.02, 0.5, 1.5, 8).collect()}
    assert got.keys() == kept.keys() and all(abs(got[c] - kept[c]) < 1e-9 for c in kept) and len(kept) > 1
    mined = {r["url"]: r["mined"] for r in url_filter.matched(pages.select("url").distinct(), spark.createDataFrame([(list(c), v) for c, v in kept.items()], "rule_tokens array<string>, confidence double")).collect()}
    assert set(mined) == {u for i, u in rows if any(set(c) <= items[i] for c in kept)}


def test_html_main_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div>'
        '<article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three<p>Short.<div class="ad">Buy</div><script>if (a < b) { x("</p>") }</script><aside>See also</aside><ul><li>item</ul><p>End &#233;</article>'
        '<section id="comments"><p>Nice post, thank you for writing it.</p></section><form><label>Mail</label></form><footer>&copy; all</footer>'
    )
    rows = spark.createDataFrame([(1, "u", page, "clash"), (2, "u", None, "c"), (3, "u", "", "c"), (4, None, "<p>" + "word " * 60 + "<p>" + "more " * 60, "c")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()}
    text = "A & B\nOne two three\nShort.\nitem\nEnd é"
    assert got[1] == (text, len(text)) and got[2] == got[3] == ("", 0) and got[4][0].count("word") == 60
    assert html_text.extract(rows.limit(0)).count() == 0


def test_malformed_pages_take_time_in_proportion():
    import time

    for part in ('<a b="x ', "<a ", "<!", "<a b='\"", "<script>", "<b 'x>", "&lt;<", "<div class=\"ad", "<!--", "</p", "<p>word "):
        times = []
        for n in (20_000, 160_000):
            began = time.perf_counter()
            html_text.blocks(part * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 40 * times[0] + 0.5, (part, times)
    for part in ("<div>x ", '<div class="a b"><p>x ', "<article>x ", "</div>", "<div class='ad-box'>"):
        began = time.perf_counter()
        html_text.blocks(part * (1_000_000 // len(part)))  # nested as deep as that
        assert time.perf_counter() - began < 8, part
    assert [b[0] for b in html_text.blocks('<p>a<b title="x > y">c</b> < d <e <p>f<br/>g<script/>h</script>n<svg/>o<svg><p>i</svg>j<!-- k --><![CDATA[l]]><?m?>')] == ["ac < d f gnoj"]


def test_names_that_only_hint_keep_no_article_out(spark):
    tree = html_text.train(spark)
    long = "".join(f"<p>{'word ' * 40}</p>" for _ in range(4))
    for wrapper in ("<div class='page has-sidebar'>", "<div class='search-history'>", "<div class='menu-recipes'>", "<body class='no-comments'>"):
        assert html_text.main_text(f"{wrapper}{long}</div>", tree).count("word") == 160
        assert html_text.main_text(f"{wrapper}<article><p>Main text</p></article></div>", tree) == "Main text"
    assert html_text.main_text(f"<div class='comments'><article>{long}</article></div><p>a<!-->b<!--->c {'more ' * 20}", tree).startswith("abc more")
    assert html_text.main_text(f"<p>{'word ' * 20}<script>no</script foo>after</p><p><script src=a/>no</script >{'tail ' * 20}</p>", tree).count("no") == 0


def test_tree_is_fitted_on_blocks_of_pages(spark):
    rows = html_text.labelled_blocks()
    tree = html_text.train(spark)
    assert len(rows) > 250 and all(html_text.is_main(tree, r[:-1]) == (r[-1] == 1) for r in rows)
    assert html_text.FEATURES[tree[0]] in ("words", "links")  # what a block is asked first


def test_html_of_given_pages(spark, sf_dir):
    import html
    import re

    for r in html_text.op6_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in parts if x)


def test_warc_against_sql(spark, sf_dir):
    assert spark_rows(warc.op7_warc(spark, sf_dir)) == sql_rows(sf_dir, warc.ORACLE)


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, "http://c/", big + "x"), (4, None, "small"), (5, "http://e/", "small"), (6, "http://f/\r\nX: y", None), (None, "http://g/", "z" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    archive = warc.read(spark, f"{tmp_path}/w")
    got = {r["page_id"]: r for r in archive.collect()}
    assert {k: bytes(r["payload"]).decode() for k, r in got.items()} == {r[0]: r[2] or "" for r in rows}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if k} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    records = {r["page_id"]: bytes(r["record"]) for r in warc.as_bytes(archive).collect()}
    head, _, rest = records[2].partition(b"\r\n\r\n")
    assert b"Content-Length: 1200" in head and rest == big.encode() + b"\r\n\r\n" and b"Content-Length: 0" in records[1] and b"\r\nX: y" not in records[6]
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 5
    warc.write(pages.unionByName(pages), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/payloads").count() == 5 and warc.read(spark, f"{tmp_path}/r").count() == 14
    spark.read.parquet(f"{tmp_path}/w/payloads").withColumn("payload", F.concat("payload", F.encode(F.lit("!"), "UTF-8"))).write.parquet(f"{tmp_path}/x/payloads")
    spark.read.parquet(f"{tmp_path}/w/headers").write.parquet(f"{tmp_path}/x/headers")
    with pytest.raises(Exception, match="damaged or missing payload"):
        warc.read(spark, f"{tmp_path}/x").collect()
    clash = pages.withColumns({c: F.lit("clash") for c in ("payload", "sha256", "record_type", "header", "page")}).filter("page_id < 3")
    warc.write(clash.unionByName(clash.limit(1).withColumns({"page_id": F.lit(9).cast("long"), "html": F.lit("long " * 400_000)})), f"{tmp_path}/c")
    got = {r["page_id"]: r for r in warc.read(spark, f"{tmp_path}/c").collect()}
    assert got[9]["payload_bytes"] == 2_000_000 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2
    warc.write(pages.limit(0), f"{tmp_path}/e")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


def test_plain_keeps_rows():
    assert plain([1.0000001, None]) == (1.0, None)
