"""Alignment of two tokenizers over a corpus: which tokens of A stand for the same bytes as which tokens of B.

Byte offsets where tokens of both end cut a document into groups. Most groups hold one token of each with the same bytes: the
identity map (A id -> the B id with its bytes) is worked out once from both vocabularies, so such a pair needs only the A id.

Where single spaces and newlines are all the white space of a text, no token of either crosses from one word into the next, so
words are aligned one by one: a worker remembers the aligned words that it met last, and a document is put together from its
words. Other texts, and those with a word that a tokenizer changes, are aligned as a whole.

1. Each task aligns segments of documents. Pairs of the identity map are counted in one vector as long as A's
   vocabulary for the whole task. All other pairs, which only groups of several tokens have, are listed once a segment, with the
   number of its documents that hold each; documents keep places in that list. Nothing is shuffled.
2. The pair lists are dealt by A id: the counts over all segments and the highest count of each A id are found there, and each
   list goes back to its segment as counts in its own order. What is shuffled is a few bytes for each different pair of a
   segment, however often its documents hold it.
3. The vectors (identity counts, highest counts) are as long as A's vocabulary at any size of the corpus, so they may pass
   through the driver. Each segment meets its lists, and documents sum up their links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _ODD_SPACE, Codec
from .common import chosen_parts, stored, table, take_turn
from .ranked_search import packed, unpacked

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SEGMENT_CHARS = 2_000_000
#: Characters of the corpus for which there is a bucket of A ids.
BUCKET_CHARS = 24_000_000
#: Groups with more pairs than these are reduced to their different ids first.
WIDE_GROUP = 4096
#: Aligned words that a worker keeps, and the tokens and pairs of them; beyond either, the half that was used last stays.
CACHED_WORDS = 400_000
CACHED_TOKENS = 8_000_000
_B = 1 << 15  # above every B id: a pair is a * _B + b

_PARTS = "segment long, bucket int, doc_ids array<long>, counts array<array<int>>, shas array<string>, entries array<binary>, codes binary, holders binary, ids array<int>, vector array<long>"
_SCHEMA = pa.schema([
    ("segment", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.list_(pa.int32()))), ("shas", pa.list_(pa.string())), ("entries", pa.list_(pa.binary())),
    ("codes", pa.binary()), ("holders", pa.binary()), ("ids", pa.list_(pa.int32())), ("vector", pa.list_(pa.int64())),
])
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligned(NamedTuple):
    """Alignments of stretches of text (words or whole texts), side by side."""

    texts: list[str]  #: the groups as text
    sums: np.ndarray  #: tokens of A and of B, groups, links
    same_sizes: np.ndarray
    same: np.ndarray  #: (A id, times) of the pairs of the identity map
    other_sizes: np.ndarray
    other: np.ndarray  #: (pair, times) of all other pairs

    def plus(self, more: Aligned) -> Aligned:
        return Aligned(self.texts + more.texts, *(np.concatenate(x) for x in zip(self[1:], more[1:], strict=True)))

    def chosen(self, which: np.ndarray) -> Aligned:
        same, other = (chosen_parts(flat, sizes, which)[0] for flat, sizes in ((self.same, self.same_sizes), (self.other, self.other_sizes)))
        return Aligned([self.texts[i] for i in which.tolist()], self.sums[which], self.same_sizes[which], same, self.other_sizes[which], other)

    def weights(self) -> np.ndarray:
        return self.sums[:, 0] + self.sums[:, 1] + self.same_sizes + self.other_sizes


def _none() -> Aligned:
    return Aligned([], np.zeros((0, 4), np.int64), *(x for _ in range(2) for x in (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))))


class Aligner:
    """Both tokenizers, the bytes of their tokens and the identity map."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Codec(a_path)
        self.a.special = None  # special tokens' strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self.a.pieces
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(names) > _B:
            raise ValueError(f"the second vocabulary has more than {_B} entries")
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        own = {s: i for i, s in reversed([*enumerate(self.b_bytes)]) if self.b.is_byte(i)} | {s: i for i, s in reversed([*enumerate(self.b_bytes)]) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.identity = np.array([own.get(s, -1) for s in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64) for x in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(names))
        self.width = most
        self.text = [f"{i}{end}" for end in ",|;" for i in range(most)]
        # words can be encoded one by one if no token of B goes on behind a space or holds a newline
        self.apart = not any("▁" in s.lstrip("▁") or "\n" in s for s in names)
        self.places: dict[str, int] = {}
        self.known = _none()
        self.used = np.zeros(0, np.int64)  # the turn in which each word was last met
        self.turn = 0

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of each text by A (of a space and the text) and by B; none for null and empty texts and for those that
        either doesn't give back byte by byte."""
        some = [i for i, t in enumerate(texts) if t]
        a_ids, b_ids = [np.zeros(0, np.int64)] * len(texts), [[] for _ in texts]
        found = zip(some, self.a.encode([" " + texts[i] for i in some]), self.b.encode([texts[i] for i in some], num_threads=1), strict=True)
        for i, a, b in found:
            whole = (" " + texts[i]).encode("utf-8", "replace")
            a = np.frombuffer(a, "<u4").astype(np.int64)
            if b"".join(map(self.b_bytes.__getitem__, b)) == whole and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole:
                a_ids[i], b_ids[i] = a, b
        return a_ids, b_ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and by B of distinct words, each with a space before it unless it begins with a newline: (ids of A, how
        many of each word, ids of B, how many). None for words that either doesn't give back byte by byte."""
        a_ids, b_ids = self.a.encode_pieces(words), self.b.encode(words, num_threads=1)
        n_a = np.fromiter(map(len, a_ids), np.int64, len(words)) >> 2
        a = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64)
        plain = [(w if w[:1] == "\n" else " " + w).encode() for w in words]
        for i, word in enumerate(words):
            if word[:1] == "\n" and b_ids[i] and self.b_bytes[b_ids[i][0]] == b" ":
                del b_ids[i][0]  # the space that B adds
        n_b = np.fromiter(map(len, b_ids), np.int64, len(words))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(n_b.sum()))
        good = np.ones(len(words), bool)
        sizes = np.cumsum(np.fromiter(map(len, plain), np.int64, len(words)))
        for ids, n, pieces, widths in ((a, n_a, self.a_bytes, self.a_sizes), (b, n_b, self.b_bytes, self.b_sizes)):
            ends = np.cumsum(n)
            back = np.concatenate([[0], np.cumsum(widths[ids])])[ends]
            if not (np.array_equal(back, sizes) and b"".join(map(pieces.__getitem__, ids.tolist())) == b"".join(plain)):
                flat = ids.tolist()
                good &= [b"".join(map(pieces.__getitem__, flat[e - k : e])) == w for w, k, e in zip(plain, n.tolist(), ends.tolist(), strict=True)]
        return a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good

    def words(self, words: list[str]) -> np.ndarray:
        """The places of distinct words in ``known``; those that aren't there are aligned first."""
        self.turn += 1
        if len(self.places) > CACHED_WORDS or int(self.known.weights().sum()) > CACHED_TOKENS:
            latest = np.argsort(-self.used, kind="stable")[: CACHED_WORDS // 2]
            kept = np.sort(latest[np.cumsum(self.known.weights()[latest]) <= CACHED_TOKENS // 2])
            names = list(self.places)
            self.places = {names[i]: k for k, i in enumerate(kept.tolist())}
            self.known, self.used = self.known.chosen(kept), self.used[kept]
        found = list(map(self.places.get, words))
        gaps = [i for i, place in enumerate(found) if place is None]
        if gaps:
            new = [words[i] for i in gaps]
            at = range(len(self.places), len(self.places) + len(new))
            self.known = self.known.plus(_aligned(self, *self.encode_words(new)))
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.places.update(zip(new, at, strict=True))
            for i, place in zip(gaps, at, strict=True):
                found[i] = place
        places = np.array(found, np.int64)
        self.used[places] = self.turn
        return places

    def align(self, texts: list[str]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """(alignments, places, owners): those at places, in order, make up the text that is their owner."""
        flat = pa.array(texts, pa.large_string())
        # U+2581 is B's own sign for a space: no word with it comes back
        whole = pc.match_substring_regex(flat, r"\A[ \n]|\x{2581}|" + _ODD_SPACE).to_numpy(zero_copy_only=False) if self.apart else np.ones(len(texts), bool)
        even = np.flatnonzero(~whole)
        lists = pc.split_pattern(pc.replace_substring(flat.take(pa.array(even)), "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        places = self.words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        owners = np.repeat(even, np.diff(lists.offsets.to_numpy()))
        known = self.known
        whole[owners[known.sums[places, 0] == 0]] = True  # a word that isn't given back
        if whole.any():
            others = np.flatnonzero(whole)
            a_ids, b_ids = self.encode([texts[i] for i in others])
            n_a, n_b = (np.fromiter(map(len, x), np.int64) for x in (a_ids, b_ids))
            b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(n_b.sum()))
            rest = ~whole[owners]
            places = np.concatenate([places[rest], len(known.texts) + np.arange(len(others))])
            owners = np.concatenate([owners[rest], others])
            order = np.argsort(owners, kind="stable")
            places, owners = places[order], owners[order]
            known = known.plus(_aligned(self, np.concatenate(a_ids), n_a, b, n_b))
        return known, places, owners


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligner(a_path: str, b_path: str) -> Aligner:
    take_turn("token_alignment", _aligner.cache_clear)
    return _aligner(a_path, b_path)


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each is there."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(times, starts)


def _gaps(owner: np.ndarray, values: np.ndarray) -> bytes:
    """Values that ascend within each owner, as packed gaps."""
    gaps = np.diff(values, prepend=0)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    gaps[first] = values[first]
    return packed(gaps)[0].tobytes()


def _from_gaps(data: bytes, sizes: np.ndarray) -> np.ndarray:
    gaps = unpacked(np.frombuffer(data, np.uint8)) if data else np.zeros(0, np.int64)
    sums = np.cumsum(gaps)
    ends = np.cumsum(sizes)
    before = np.where(ends - sizes > 0, sums[np.maximum(ends - sizes - 1, 0)], 0) if len(sums) else np.zeros(len(sizes), np.int64)
    return sums - np.repeat(before, sizes)


def _pairs(ga: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all pairs within groups of several tokens. ga: the group of each A token; na, nb: tokens of
    each group."""
    first_b = np.cumsum(nb) - nb
    wide = na * nb > WIDE_GROUP
    mine = ~((na == 1) & (nb == 1))[ga] & ~wide[ga]
    reps = nb[ga[mine]]
    ends = np.cumsum(reps)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first_b[ga[mine]] - (ends - reps), reps)
    groups, codes = [np.repeat(ga[mine], reps)], [np.repeat(a[mine], reps) * _B + b[at]]
    times = [np.ones(len(at), np.int64)]
    first_a = np.cumsum(na) - na
    for g in np.flatnonzero(wide).tolist():
        (xs, nx), (ys, ny) = (np.unique(ids[s : s + n], return_counts=True) for ids, s, n in ((a, first_a[g], na[g]), (b, first_b[g], nb[g])))
        codes.append((xs[:, None] * _B + ys[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
        groups.append(np.full(len(codes[-1]), g))
    return np.concatenate(groups), np.concatenate(codes), np.concatenate(times)


def _aligned(tool: Aligner, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Aligned:
    """The alignments of stretches of text from their ids of A and B, side by side, and how many each has of them."""
    size = len(n_a)
    ends_a, ends_b = np.cumsum(tool.a_sizes[a]), np.cumsum(tool.b_sizes[b])
    marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool)
    marks[ends_b] = True
    cut_a = marks[ends_a]
    marks[:] = False
    marks[ends_a] = True
    cut_b = marks[ends_b]
    del marks, ends_a, ends_b
    ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n = int(cut_a.sum())
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    owner = np.repeat(np.arange(size), n_a)[np.cumsum(na) - 1] if n else np.zeros(0, np.int64)
    n_groups = np.bincount(owner, minlength=size)
    n_links = np.bincount(owner, weights=(na * nb).astype(np.float64), minlength=size).astype(np.int64)

    # the groups as text
    line = np.empty(len(a) + len(b), np.int64)
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    line[np.arange(len(a)) + first_b[ga]] = a + tool.width * cut_a
    line[np.arange(len(b)) + (first_a + na)[gb]] = b + 2 * tool.width * cut_b
    parts = list(map(tool.text.__getitem__, line.tolist()))
    cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    texts = ["".join(parts[s:e])[:-1] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    del line, parts

    group, code, times = _pairs(ga, a, na, b, nb)
    single = (na == 1) & (nb == 1)
    code = np.concatenate([code, a[first_a[single]] * _B + b[first_b[single]]])
    owner = np.concatenate([owner[group], owner[single]])
    times = np.concatenate([times, np.ones(int(single.sum()), np.int64)])
    same = tool.identity[code // _B] == code % _B
    columns = []
    for mine, ids in ((same, code // _B), (~same, code)):
        keys, often = _counted((owner[mine] << 31) | ids[mine], times[mine])
        columns += [np.bincount(keys >> 31, minlength=size), np.stack([keys & 0x7FFFFFFF, often], axis=1)]
    return Aligned(texts, np.stack([n_a, n_b, n_groups, n_links], axis=1), *columns)


def _segment(tool: Aligner, number: int, buckets: int, ids: list, texts: list[str | None], vector: np.ndarray) -> list[dict]:
    """The rows of a segment: one of its documents, and its pair list by bucket; identity pairs are added to ``vector``."""
    order = sorted(range(len(ids)), key=lambda i: ids[i] is None)  # documents without an id come last
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    parts, places, owners = tool.align([texts[i] for i in some])
    doc = some[owners]
    edges = np.searchsorted(doc, np.arange(len(ids) + 1))
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(parts.sums[places], axis=0)])
    n_a, n_b, n_groups, n_links = np.diff(sums[edges], axis=0).T
    lines = list(map(parts.texts.__getitem__, places.tolist()))
    cuts = edges.tolist()
    shas = [hashlib.sha256(";".join(lines[s:e]).encode()).hexdigest() if n else "" for s, e, n in zip(cuts[:-1], cuts[1:], n_a.tolist(), strict=True)]
    del lines, sums

    # the different words of each document, and how often it has them
    held, often = np.unique(doc * len(parts.texts) + places, return_counts=True)
    doc, places = np.divmod(held, len(parts.texts)) if len(held) else (held, held)
    found = []
    for flat, sizes in ((parts.same, parts.same_sizes), (parts.other, parts.other_sizes)):
        pairs, n = chosen_parts(flat, sizes, places)[0], sizes[places]
        found.append((np.repeat(doc, n), pairs[:, 0], np.repeat(often, n) * pairs[:, 1]))
    (doc, code, times), others = found
    keys, often = _counted((doc << 16) | code, times)
    entries = [_gaps(keys >> 16, keys & 0xFFFF), packed(often)[0].tobytes()]
    n_same = np.bincount(keys >> 16, minlength=len(ids))
    vector += np.bincount(keys & 0xFFFF, minlength=len(vector))
    doc, code, times = others
    keys, often = _counted((doc << 31) | code, times)
    own = keys & 0x7FFFFFFF
    listed, place = np.unique(own, return_inverse=True)
    by = np.argsort((listed // _B) % buckets, kind="stable")  # the list by bucket, then by pair
    rank = np.empty(len(listed), np.int64)
    rank[by] = np.arange(len(listed))
    pair_doc, place = keys >> 31, rank[place]
    order = np.lexsort((place, pair_doc))
    entries += [_gaps(pair_doc, place[order]), packed(often[order])[0].tobytes()]
    holders = np.bincount(place, minlength=len(listed))
    listed = listed[by]
    counts = np.stack([n_a, n_b, n_groups, n_links, n_same, np.bincount(pair_doc, minlength=len(ids))])
    rows = [{"segment": number, "bucket": -1, "doc_ids": [i for i in ids if i is not None], "counts": [c.tolist() for c in counts], "shas": shas, "entries": entries}]
    edges = np.searchsorted((listed // _B) % buckets, np.arange(buckets + 1)).tolist()
    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if e > s:
            rows.append({"segment": number, "bucket": k, "codes": _gaps(np.zeros(e - s), listed[s:e]), "holders": packed(holders[s:e])[0].tobytes()})
    return rows


def _paired(batches: Iterator[pa.RecordBatch], buckets: int, a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    tool = aligner(a_path, b_path)
    number = TaskContext.get().partitionId() << 32
    vector = np.zeros(len(tool.a_bytes), np.int64)
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= SEGMENT_CHARS:
                yield pa.RecordBatch.from_pylist(_segment(tool, number, buckets, ids, texts, vector), _SCHEMA)
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield pa.RecordBatch.from_pylist(_segment(tool, number, buckets, ids, texts, vector), _SCHEMA)
    held = np.flatnonzero(vector)
    if len(held):
        yield pa.RecordBatch.from_pylist([{"bucket": -2, "ids": held, "vector": vector[held]}], _SCHEMA)


def _counts(bucket: pd.DataFrame, identity: np.ndarray) -> pd.DataFrame:
    """For each segment's pairs of a bucket of A ids: how many documents hold each and whether that is the highest of its A id;
    and a row (segment null) with the highest counts of the A ids of the bucket."""
    lists = [np.cumsum(unpacked(np.frombuffer(c, np.uint8))) for c in bucket["codes"]]
    codes = np.concatenate(lists)
    pairs, at = np.unique(codes, return_inverse=True)
    del codes
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at, np.concatenate([unpacked(np.frombuffer(h, np.uint8)) for h in bucket["holders"]]))
    a = pairs // _B
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    ids, most = a[starts], np.maximum.reduceat(total, starts)
    top = np.maximum(most, identity[ids])
    best = total == np.repeat(top, np.diff(np.append(starts, len(a))))
    cuts = np.cumsum([0, *map(len, lists)]).tolist()
    rows = [(s, k, packed(total[at[x:y]])[0].tobytes(), np.packbits(best[at[x:y]]).tobytes(), y - x, None, None) for s, k, x, y in zip(bucket["segment"], bucket["bucket"], cuts[:-1], cuts[1:], strict=True)]
    rows.append((None, -1, None, None, 0, ids.tolist(), top.tolist()))
    return pd.DataFrame(rows, columns=["segment", "bucket", "totals", "best", "size", "ids", "vector"]).astype({"segment": "Int64"})


def _sums(parts: pd.DataFrame, lists: pd.DataFrame, identity: np.ndarray, top: np.ndarray) -> pd.DataFrame:
    """The result rows of a segment's documents."""
    docs, lists = parts.iloc[0], lists.sort_values("bucket")
    n_a, n_b, n_groups, n_links, n_same, n_other = (np.asarray(c, np.int64) for c in docs["counts"])
    total = np.concatenate([np.zeros(0, np.int64), *(unpacked(np.frombuffer(t, np.uint8)) for t in lists["totals"])])
    best = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(lists["best"], lists["size"], strict=True))])
    size = len(n_a)
    same_ids, same_times, places, times = docs["entries"]
    ids, places = _from_gaps(same_ids, n_same), _from_gaps(places, n_other)
    same_times, times = (unpacked(np.frombuffer(x, np.uint8)) if x else np.zeros(0, np.int64) for x in (same_times, times))
    count_sum, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for doc, often, count, is_best in ((np.repeat(np.arange(size), n_same), same_times, identity[ids], identity[ids] == top[ids]), (np.repeat(np.arange(size), n_other), times, total[places], best[places])):
        np.add.at(count_sum, doc, often * count)
        np.add.at(n_best, doc, often * is_best)
    doc_ids = docs["doc_ids"].tolist()
    doc_ids += [None] * (size - len(doc_ids))
    return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": n_best, "count_sum": count_sum, "groups_sha256": list(docs["shas"])})


def _vector(rows: DataFrame, how, size: int) -> np.ndarray:
    """A vector as long as A's vocabulary from (ids, vector) rows; ``how`` joins entries of an id."""
    found = rows.select(F.explode(F.arrays_zip("ids", "vector")).alias("e")).groupBy(F.col("e.ids").alias("a")).agg(how("e.vector").alias("n"))
    out = np.zeros(size, np.int64)
    for a, n in found.collect():  # at most an entry for each id of A
        out[a] = n
    return out


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text; further columns are not read): n_a, n_b, n_groups, n_links (pairs of
    occurrences that share a group), n_best (links whose pair's count is the highest of its A id), count_sum (of the pairs' counts, over
    links) and groups_sha256. A pair's count is the number of rows that hold it linked.

    Null and empty texts, and those that a tokenizer changes, have no tokens: zeros and an empty string. Rows that share a
    doc_id or have none are documents of their own. An empty table gives an empty result.
    """
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    size = len(Codec(paths[0]).pieces)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(max(8, -(-chars // BUCKET_CHARS)), size))
    parts = stored(texts.mapInArrow(lambda batches: _paired(batches, buckets, *paths), _PARTS), "alignment-parts")
    identity = _vector(parts.filter("bucket = -2"), F.sum, size)
    lists = parts.filter("bucket >= 0").select("segment", "bucket", "codes", "holders")
    kind = "segment long, bucket int, totals binary, best binary, size int, ids array<int>, vector array<long>"
    counted = stored(lists.groupBy("bucket").applyInPandas(lambda bucket: _counts(bucket, identity), kind), "alignment-counts")
    top = np.maximum(identity, _vector(counted.filter("segment is null"), F.max, size))
    own = parts.filter("bucket = -1").select("segment", "doc_ids", "counts", "shas", "entries")
    theirs = counted.filter("segment is not null").select("segment", "bucket", "totals", "best", "size")
    return own.groupBy("segment").cogroup(theirs.groupBy("segment")).applyInPandas(lambda x, y: _sums(x, y, identity, top), _RESULT)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
