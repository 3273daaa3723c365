"""Ranked lexical search: Block-Max MaxScore over compressed index segments, whose best documents are merged.

1. Each task turns the documents of its partition into segments; one ends with the text that brings it to SEGMENT_CHARS characters.
   A segment numbers its documents by ascending doc_id and holds, for each term, a list of blocks of BLOCK
   postings: gaps and frequencies as variable bytes, and beside them what bounds the block's scores. Nothing is shuffled.
2. A bound must not depend on corpus statistics, which are known only afterwards. Therefore a block keeps, for each of four
   classes of frequency (1, 2, 3 to 4, more), the largest frequency and the smallest document length: a score grows with
   the one and falls with the other, so the largest score of the four corners bounds the block, and that of all blocks the list.
3. A search joins the asked terms to the lists. What is asked goes along in blocks of at most QUERIES items, so each group is a
   segment and such a block. In a group, documents are taken in windows. Lists whose bounds together stay below the k-th best
   score so far are not essential: a document only in such lists can't get in. The others give the candidates of a window;
   then the rest is added list by list, from the largest bound down. Before a block of these is decompressed, candidates
   that can't reach the k-th score even with the block's maximum are dropped.
4. Each segment gives its k best for an item, and a window function merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, take_turn

SEGMENT_CHARS = 12_000_000
BLOCK = 128
WINDOW = 2048
QUERIES = 500
K = 10

#: Letters, digits and all that is not ASCII make terms; the rest parts them; A-Z count as a-z.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: The frequencies at which classes begin.
_CLASSES = np.array([1, 2, 3, 5])

_ROWS = pa.schema([
    ("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("last", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
    ("most", pa.list_(pa.int32())), ("least", pa.list_(pa.int32())), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
])
_INDEX = "segment long, term string, df long, last array<int>, ends array<int>, most array<int>, least array<int>, data binary, doc_ids array<long>, lengths array<int>"


def words(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each value in them): seven bits a byte, low ones first, the top bit marks that more follow."""
    values = values.astype(np.uint64)
    sizes = 1 + sum((values >= (1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        out[(ends - sizes)[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint64)
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    """The values of ``packed`` bytes."""
    last = data < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), starts)


class _Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def segment(number: int, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """The index rows of some documents: one of the documents themselves (term null), then one for each term, by term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    vocabulary = _Ids()
    found = [np.fromiter(map(vocabulary.__getitem__, words(texts[i])), np.int64) for i in order]
    lengths = np.array([len(f) for f in found], np.int64)
    head = {"segment": [number], "doc_ids": [[ids[i] for i in order if ids[i] is not None]], "lengths": [lengths]}
    columns = [pa.array(head.get(f.name, [None]), f.type) for f in _ROWS]
    if not vocabulary:
        return pa.RecordBatch.from_arrays(columns, schema=_ROWS)
    names = sorted(vocabulary)
    place = np.empty(len(names), np.int64)
    place[[vocabulary[w] for w in names]] = np.arange(len(names))
    keys, tf = np.unique(place[np.concatenate(found)] * len(order) + np.repeat(np.arange(len(order)), lengths), return_counts=True)
    term, doc = keys // len(order), keys % len(order)
    starts = np.flatnonzero(np.diff(term, prepend=-1))  # of lists
    df = np.diff(np.append(starts, len(term)))
    blocks_of = -(-df // BLOCK)
    block_starts = np.repeat(starts, blocks_of) + BLOCK * (np.arange(blocks_of.sum()) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of))
    sizes = np.diff(np.append(block_starts, len(term)))
    lasts = doc[block_starts + sizes - 1]
    gaps = np.diff(doc, prepend=0)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gaps[first] = doc[first]
    # a block holds its gaps, then its frequencies
    shift = np.arange(len(term)) + np.repeat(block_starts, sizes)
    values = np.empty(2 * len(term), np.int64)
    values[shift], values[shift + np.repeat(sizes, sizes)] = gaps, tf
    data, widths = packed(values)
    block_bytes = np.add.reduceat(widths, 2 * block_starts)
    list_blocks = np.concatenate([[0], np.cumsum(blocks_of)])
    list_bytes = np.concatenate([[0], np.cumsum(block_bytes)])[list_blocks]
    ends = np.cumsum(block_bytes) - np.repeat(list_bytes[:-1], blocks_of)
    kind = np.searchsorted(_CLASSES, tf, "right") - 1
    most, least = np.zeros((len(sizes), 4), np.int32), np.full((len(sizes), 4), 2**31 - 1, np.int32)
    for c in range(4):
        most[:, c] = np.maximum.reduceat(np.where(kind == c, tf, 0), block_starts)
        least[:, c] = np.minimum.reduceat(np.where(kind == c, lengths[doc], 2**31 - 1), block_starts)
    rows = [
        pa.array(np.full(len(names), number)), pa.array([w.decode("utf-8") for w in names]), pa.array(df), _lists(list_blocks, lasts.astype(np.int32), pa.int32()), _lists(list_blocks, ends.astype(np.int32), pa.int32()),
        _lists(4 * list_blocks, most.ravel(), pa.int32()), _lists(4 * list_blocks, least.ravel(), pa.int32()),
        pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(list_bytes.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
        pa.nulls(len(names), pa.list_(pa.int64())), pa.nulls(len(names), pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, rows, strict=True)], schema=_ROWS)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_turn("ranked_search")
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        found = segment(number, ids, texts)
        for start in range(0, len(found), 20_000):
            yield found.slice(start, 20_000)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= SEGMENT_CHARS:
                yield from rows()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield from rows()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text; further columns are not read): for each segment a row with its documents
    (doc_ids, those without one come last and have none; lengths; term null) and one for each term.

    A null or empty text, or one without a term, has length 0 and is in no list. Rows that share a doc_id, or have none, are
    documents of their own.
    """
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_segments, _INDEX), "search-index")


class _List:
    """A term's list in a segment; blocks are decompressed when they are asked for, and then kept while the group is."""

    def __init__(self, row, m: np.ndarray, of_length) -> None:
        self.last, self.ends, self.m, self.w = np.asarray(row.last), np.asarray(row.ends), m, int(row.w)
        self.data = np.frombuffer(row.data, np.uint8)
        most, least = np.asarray(row.most, np.int64), np.asarray(row.least, np.int64)
        corner = np.where(most > 0, 1_000_000_000 * most // (1000 * most + 8 * of_length(np.where(most > 0, least, 0))), 0)
        self.maxima = self.w * corner.reshape(-1, 4).max(1)
        self.bound = int(self.maxima.max())
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a block."""
        if b not in self.kept:
            values = unpacked(self.data[self.ends[b - 1] if b else 0 : self.ends[b]])
            half = len(values) // 2
            docs = np.cumsum(values[:half]) + (self.last[b - 1] if b else 0)
            tf = values[half:]
            self.kept[b] = docs, self.w * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]))
        return self.kept[b]

    def between(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) from start up to stop."""
        parts = [self.block(b) for b in range(int(np.searchsorted(self.last, start)), min(int(np.searchsorted(self.last, stop - 1)) + 1, len(self.last)))]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = (np.concatenate([p[i] for p in parts]) for i in (0, 1)) if len(parts) > 1 else parts[0]
        a, b = np.searchsorted(docs, [start, stop])
        return docs[a:b], scores[a:b]


def best_of_segment(asked: list[tuple[_List, int]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): the k best of a segment of ``size`` documents with a score above 0, equal ones by number.

    asked: the lists of the terms that the segment has, each with how often it is asked for.
    """
    asked = sorted(asked, key=lambda a: a[0].bound * a[1])
    bounds = np.array([one.bound * times for one, times in asked], np.int64)
    below = np.cumsum(bounds)  # the most that a list and all with smaller bounds can add
    top_docs, top_scores, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), 1  # a score under ``reach`` can't get in
    for start in range(0, size, WINDOW):
        stop = min(start + WINDOW, size)
        first = int(np.searchsorted(below, reach))  # the first essential list
        if first == len(asked):
            break
        score, seen = np.zeros(stop - start, np.int64), np.zeros(stop - start, bool)
        for one, times in asked[first:]:
            docs, parts = one.between(start, stop)
            score[docs - start] += times * parts
            seen[docs - start] = True
        left = np.flatnonzero(seen)
        for i in range(first - 1, -1, -1):
            left = left[score[left] + below[i] >= reach]
            if not len(left):
                break
            one, times = asked[i]
            at = np.searchsorted(one.last, left + start)
            inside = at < len(one.last)
            most = np.where(inside, one.maxima[np.minimum(at, len(one.last) - 1)] * times, 0)
            fits = score[left] + most + (below[i - 1] if i else 0) >= reach
            left, at = left[fits], at[fits]
            for b in np.unique(at[at < len(one.last)]).tolist():
                mine = left[at == b]
                docs, parts = one.block(b)
                p = np.minimum(np.searchsorted(docs, mine + start), len(docs) - 1)
                hit = docs[p] == mine + start
                score[mine[hit]] += times * parts[p[hit]]
        left = left[score[left] >= reach]
        docs, scores = np.concatenate([top_docs, left + start]), np.concatenate([top_scores, score[left]])
        order = np.lexsort((docs, -scores))[:k]
        top_docs, top_scores = docs[order], scores[order]
        if len(order) == k:
            reach = max(reach, int(top_scores[-1]))
    return top_docs, top_scores


def _best(group: pd.DataFrame, k: int) -> pd.DataFrame:
    take_turn("ranked_search")
    head = group[group["doc_ids"].notna()].iloc[0]
    lengths, doc_ids = np.asarray(head.lengths, np.int64), head.doc_ids.tolist()
    doc_ids += [None] * (len(lengths) - len(doc_ids))
    terms, total = int(head.terms or 0), int(head.documents or 0)

    def of_length(n: np.ndarray) -> np.ndarray:
        if not terms:
            return np.full(len(n), 25)
        if 75 * int(n.max(initial=0)) * total < 2**63:
            return 25 + 75 * n * total // terms
        return np.array([25 + 75 * x * total // terms for x in n.tolist()], np.int64)

    m = of_length(lengths)
    asked: dict[object, list[tuple[_List, int]]] = {}
    for row in group[group["term"].notna()].itertuples():
        if row.w > 0:
            one = _List(row, m, of_length)
            for ask in row.asks:
                asked.setdefault(ask["query_id"], []).append((one, ask["times"]))
    out = [(query, doc_ids[d], s) for query, lists in asked.items() for d, s in zip(*(x.tolist() for x in best_of_segment(lists, len(lengths), k)), strict=True)]
    queries, docs, scores = map(list, zip(*out, strict=True)) if out else ([], [], [])
    return pd.DataFrame({"query_id": queries, "doc_id": pd.array(docs, "Int64"), "score": pd.array(scores, "int64")})


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (query_id, text), equal scores by doc_id.

    Terms are as in ``words``. A null or empty text, and one whose terms no document has, has no row; rows with a null
    query_id are left out; rows that share a query_id are one query with the terms of all. Repeated terms count as often
    as they are asked for. Documents without an id come last among equal scores. An empty table on either side gives no row.
    """
    term = F.explode(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    asked = queries.filter("query_id is not null").select("query_id", term.alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    # stored, so that Spark knows their size: it broadcasts them where they are small, and then no list moves before it is asked for
    asks = stored(asked.groupBy("block", "term").agg(F.collect_list(F.struct("query_id", "times")).alias("asks")), "search-asks")  # at most a block of queries
    lists, heads = index.filter("term is not null"), index.filter("term is null")
    totals = heads.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms"))
    frequencies = lists.join(asks.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("in_all"))
    weight = F.floor(1000 * F.log((2 * F.col("documents") + 2) / (2 * F.col("in_all") + 1)))
    weighed = stored(asks.join(frequencies, "term").crossJoin(F.broadcast(totals)).select("block", "term", "asks", weight.alias("w")), "search-weights")  # totals: one row
    none = lambda *names: [F.lit(None).cast(dict(index.dtypes)[n]).alias(n) for n in names]
    body = ["last", "ends", "most", "least", "data"]
    members = lists.join(weighed, "term").select("segment", "block", "term", "w", "asks", *body, *none("doc_ids", "lengths"), F.lit(None).cast("long").alias("documents"), F.lit(None).cast("long").alias("terms"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind = dict(queries.dtypes)["query_id"]
    beside = heads.crossJoin(F.broadcast(totals)).select("segment", every.alias("block"), *none("term"), F.lit(None).cast("long").alias("w"), F.lit(None).cast(f"array<struct<query_id:{kind},times:bigint>>").alias("asks"), *none(*body), "doc_ids", "lengths", "documents", "terms")
    found = members.unionByName(beside).groupBy("segment", "block").applyInPandas(lambda group: _best(group, k), f"query_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search(build_index(table(spark, sf_dir, "documents")), items).withColumnRenamed("query_id", "item_id")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, len(ts) AS n FROM t WHERE len(ts) > 0),
tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
m AS (SELECT r, doc_id, 25 + (75 * n * docs) // terms AS m FROM d, tot),
s AS (SELECT item_id, r, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r), tot GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
