"""Ranked search, token alignment and the Jaccard join against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import jaccard_join, ranked_search, registry, token_alignment
from tests.oracle import spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, rank int, score string, n_a long, component_id long, term string"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog in the yard today."), (2, "the CAT sat on the mat\nand looked at the dog in the yard today."), (2, "the CAT sat on the mat\nand looked at the dog in the yard today."),
    (3, None), (4, ""), (5, " \n\t "), (6, "12345 !!"), (7, LONG), (8, LONG + " end"), (None, "A cat without an id, but with words."), (9, "Der Hund und die Katze, Straße ÄÖÜ; naïve café déjà vu"),
    (10, "two words"), (11, "two words"), (2**60 + 1, "a cat with a large id, and Two WORDS"), (2**60 + 3, "two WORDS"), (12, "<|endoftext|> x<s> </s><|endoftext|>"), (13, "— ‘déjà vu’ 中文 😀  double  space\r\n\r\nend ▁ "), (14, "a" * 3000), (15, "cat cat cat cat dog"), (16, "中文 😀 \x85 é ﬁ  \t\t x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", 7, "clash", 5, 6, "clash") for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_jaccard_join"])
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert spark_rows(registry.QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, registry.ORACLE_SQL[name])


# ranked search


def ranked(rows, items, k=10):
    terms = [(d, ranked_search.words(t)) for d, t in rows]
    terms = [(d, t, Counter(t)) for d, t in terms if t]
    n, total, df = len(terms), sum(len(t) for _, t, _ in terms), Counter(w for _, t, _ in terms for w in set(t))
    asked = defaultdict(Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(ranked_search.words(text))
    out = []
    for item, words in asked.items():
        found = []
        for d, t, tf in terms:
            m = 25 + 75 * len(t) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w, times in words.items() if w in tf)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "cat dog"), (2, "the CAT, the cat; the mat"), (3, None), (4, ""), (5, "!!"), (6, "nowhere"), (None, "cat"), (7, "word1 word2 other3 12345"), (8, "katze straße ÄÖÜ 中文 😀"), (9, "cat"), (9, "dog dog"), (10, LONG)]


def test_ranked_search_of_awkward_rows(spark, docs):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "query_id long, text string, rank int")
    found = ranked_search.search(ranked_search.build_index(docs), items)
    assert found.columns == ["query_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == ranked(ROWS, ITEMS)


@pytest.mark.parametrize(("chars", "queries", "window"), [(2_000, 2, 64), (10**9, 500, 2048), (50_000, 3, 16)])
def test_ranked_search_whatever_the_segments_blocks_and_windows(spark, monkeypatch, chars, queries, window):
    for module_name, value in (("SEGMENT_CHARS", chars), ("QUERIES", queries), ("WINDOW", window), ("BLOCK", 16)):
        monkeypatch.setattr(ranked_search, module_name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 300)) for i in rng.permutation(900)]
    items = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 6) % 300)) for i in range(12)]
    found = []
    for start in range(0, 900, 300):  # segments are made where the rows lie, also without Spark
        found.append(ranked_search.segment(start, *map(list, zip(*rows[start : start + 300], strict=True))))
    index = ranked_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    assert sum(len(f) for f in found) >= index.count() - 900
    got = ranked_search.search(index, spark.createDataFrame(items, "query_id long, text string"), 7)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, 7)


def test_ranked_search_leaves_blocks_packed(spark):
    """Blocks of terms that can't bring a document among the best are not decompressed."""
    rows = [(i, "common " * (1 + (i < 20)) + ("rare " * 3 if i < 12 else "filler more")) for i in range(6000)]
    batch = ranked_search.segment(0, *map(list, zip(*rows, strict=True))).to_pandas()
    lengths = np.asarray(batch.iloc[0].lengths, np.int64)
    m = 25 + 75 * lengths * 6000 // lengths.sum()
    lists = []
    for row in batch[batch["term"].isin(["common", "rare"])].itertuples():
        row = row._replace() if hasattr(row, "_replace") else row
        lists.append(ranked_search._List(type("Row", (), {**{c: getattr(row, c) for c in ("last", "ends", "most", "least", "data")}, "w": {"common": 5, "rare": 9000}[row.term]}), m, lambda n: 25 + 75 * n * 6000 // lengths.sum()))
    docs, scores = ranked_search.best_of_segment([(one, 1) for one in lists], 6000, 10)
    assert docs.tolist() == list(range(10)) and (scores > 0).all()
    common = next(one for one in lists if one.w == 5)
    assert len(common.last) == 47 and len(common.kept) < 20


def test_packed_values_come_back():
    values = np.concatenate([np.arange(300), 2 ** np.arange(35) - 1, 2 ** np.arange(35)])
    data, sizes = ranked_search.packed(values)
    assert ranked_search.unpacked(data).tolist() == values.tolist() and sizes.sum() == len(data)


def test_ranked_search_of_nothing(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "query_id long, text string")
    assert ranked_search.search(ranked_search.build_index(nothing), items).count() == 0
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).count() == 0


# token alignment


class Plain:
    """Alignment by walking through both token lists."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        self.letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        pieces = [self.b.id_to_piece(i) for i in b]
        x = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return []
        ends = [np.cumsum([len(t) for t in z]).tolist() for z in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        return [([i for i, e in zip(a, ends[0], strict=True) if s < e <= t], [i for i, e in zip(b, ends[1], strict=True) if s < e <= t]) for s, t in zip([0, *cuts], cuts, strict=False)]

    def result(self, rows):
        found = [(d, self.groups(t)) for d, t in rows]
        pairs = [[(p, q) for a, b in g for p in a for q in b] for _, g in found]
        count = Counter(x for each in pairs for x in set(each))
        top = defaultdict(int)
        for (p, _), n in count.items():
            top[p] = max(top[p], n)
        out = []
        for (d, g), each in zip(found, pairs, strict=True):
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            sums = sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(each), sum(count[x] == top[x[0]] for x in each), sum(count[x] for x in each)
            out.append((d, *sums, hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return sorted(out, key=str)


SHORT = [(d, t if t is None or len(t) < 5000 else t[:4000]) for d, t in ROWS]


def test_alignment_of_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "en", 7, "clash", 5, 6, "clash") for r in SHORT], DOCS).repartition(3)
    assert sorted(map(tuple, token_alignment.align(docs).collect()), key=str) == Plain().result(SHORT)


@pytest.mark.parametrize(("chars", "bucket", "wide"), [(500, 1, 4096), (10**9, 10**9, 1), (3000, 100_000, 6)])
def test_alignment_whatever_the_segments_and_buckets(spark, sf_dir, monkeypatch, chars, bucket, wide):
    for name, value in (("SEGMENT_CHARS", chars), ("BUCKET_CHARS", bucket)):
        monkeypatch.setattr(token_alignment, name, value)
    rows = [(r.doc_id, (r.text or "")[: 300 + 7 * r.doc_id]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 40").collect()]
    got = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    assert sorted(map(tuple, got.collect()), key=str) == Plain().result(rows)


class Counting:
    """A tokenizer that counts the characters that it is given."""

    def __init__(self, tool):
        self.tool, self.chars = tool, 0

    def encode(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tool.encode(texts, **options)


def test_alignment_encodes_a_word_once_whatever_holds_it():
    tool = token_alignment.Aligner(*map(public_tokenizers.path, (token_alignment.A_FILE, token_alignment.B_FILE)))
    tool.b = Counting(tool.b)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(words[k:] + words[:k]) + "\nword7" for k in range(50)]
    for number in range(3):
        token_alignment._segment(tool, number, 8, [*range(50)], texts, np.zeros(len(tool.a_bytes), np.int64))
    assert tool.b.chars <= sum(map(len, set(" ".join(texts).replace("\n", " \n").split(" "))))
    # white space side by side, or a word that B changes: the text as a whole
    token_alignment._segment(tool, 3, 8, [0, 1], ["word1  word2", "word1 ▁"], np.zeros(len(tool.a_bytes), np.int64))
    assert tool.b.chars >= 2 * len("word1 ▁")


@pytest.mark.parametrize(("words", "tokens"), [(0, 10**9), (30, 10**9), (10**9, 60)])
def test_alignment_whatever_a_worker_remembers(monkeypatch, words, tokens):
    monkeypatch.setattr(token_alignment, "CACHED_WORDS", words)
    monkeypatch.setattr(token_alignment, "CACHED_TOKENS", tokens)
    tool, plain = token_alignment.Aligner(*map(public_tokenizers.path, (token_alignment.A_FILE, token_alignment.B_FILE))), Plain()
    texts = [t for _, t in SHORT if t] + ["the cat\nand the dog\n", "\nthe cat", "the cat ", " the cat", "the\n cat", "cat▁s and the dog"]
    for part in (texts[:9], texts[5:], texts[::-1], texts):
        known, places, owners = tool.align(part)
        got = [";".join(known.texts[k] for k in places[owners == i]) for i in range(len(part))]
        assert got == [";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain.groups(t)) for t in part]
        assert len(tool.places) == len(tool.known.texts) == len(tool.used)


def test_pairs_of_wide_groups_are_the_same():
    ga, gb = np.repeat([0, 1, 2], [3, 1, 5]), np.repeat([0, 1, 2], [2, 1, 6])
    a, b = np.array([7, 8, 7, 5, 1, 1, 2, 1, 1]), np.array([4, 4, 9, 3, 3, 6, 3, 3, 6])
    na, nb = np.bincount(ga), np.bincount(gb)

    def counted(limit):
        token_alignment.WIDE_GROUP, before = limit, token_alignment.WIDE_GROUP
        found = Counter()
        for g, code, n in zip(*token_alignment._pairs(ga, a, na, b, nb), strict=True):
            found[int(g), int(code)] += int(n)
        token_alignment.WIDE_GROUP = before
        return found

    assert counted(4096) == counted(1) and sum(counted(1).values()) == 36


def test_alignment_of_nothing(nothing):
    assert token_alignment.align(nothing).count() == 0


# Jaccard join


def components(rows, percent=80):
    sets, ids = defaultdict(list), {d for d, _ in rows if d is not None}
    for d, t in rows:
        if d is not None and t:
            s = set(jaccard_join.shingles(t).tolist())
            if s:
                sets[d].append(s)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(sorted(sets), 2):
        if any(100 * len(p & q) >= percent * len(p | q) for p in sets[x] for q in sets[y]):
            i, j = find(x), find(y)
            root[max(i, j)] = min(i, j)
    return sorted([(d, len(set(jaccard_join.shingles(t).tolist())), None if d is None else find(d)) for d, t in rows], key=str)


def joined(spark, rows):
    return sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)


def test_jaccard_join_of_awkward_rows(docs):
    found = jaccard_join.jaccard_components(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == components(ROWS)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"e{rng.integers(10**9)}"
    return words


def corpus(seed):
    """Groups of near copies about the threshold, texts on a template, shared passages, and texts of their own."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        base = [f"b{x}" for x in rng.integers(0, 10**9, rng.integers(20, 160))]
        texts += [edited(rng, base, int(rng.integers(0, max(2, len(base) // 35)))) for _ in range(rng.integers(2, 9))]
    template = [f"t{x}" for x in range(120)]
    for _ in range(60):
        texts.append(template[: rng.integers(100, 121)] + [f"u{x}" for x in rng.integers(0, 10**9, rng.integers(5, 25))])
    passage = [f"p{x}" for x in range(60)]
    for _ in range(40):
        own = [f"o{x}" for x in rng.integers(0, 10**9, 80)]
        texts.append(own[:40] + passage + own[40:])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "rows", "shingles", "pairs", "small"), [(1, 2000, 10**6, 200_000, 64), (2, 7, 1000, 50, 4), (3, 3, 10**6, 7, 1)])
def test_jaccard_join_whatever_the_blocks(spark, monkeypatch, seed, rows, shingles, pairs, small):
    for name, value in (("SMALL_REGION", small), ("PARTNERS", 2), ("BLOCK_ROWS", rows), ("BLOCK_SHINGLES", shingles), ("PAIRS", pairs), ("BUCKET_CHARS", 4000), ("PACK_ROWS", 37)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = corpus(seed)
    assert joined(spark, texts) == components(texts)


def test_jaccard_join_finds_pairs_in_a_template(spark):
    """Most of a text is shared by all; only planted pairs are near enough."""
    rng = np.random.default_rng(9)
    shared = [f"s{x}" for x in range(300)]
    rows = []
    for i in range(400):
        own = [f"x{x}" for x in rng.integers(0, 10**9, 100)]
        texts = [own] if i % 2 else [own, [*own[:75], *(f"y{x}" for x in rng.integers(0, 10**9, 25))]]
        rows += [(len(rows) + k, " ".join(shared + t)) for k, t in enumerate(texts)]
    found = joined(spark, rows)
    assert found == components(rows)
    assert sum(d != c for d, _, c in found) == 200


def test_a_large_group_of_near_copies_is_one(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    base = [f"b{x}" for x in range(200)]
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(1500)]
    assert {c for _, _, c in joined(spark, rows)} == {0}


def test_jaccard_join_of_nothing(nothing):
    assert jaccard_join.jaccard_components(nothing).count() == 0
