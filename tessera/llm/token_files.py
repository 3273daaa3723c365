"""Token ids in binary files: length-limited canonical Huffman codes from global counts.

A corpus becomes a folder with two Parquet tables. ``code`` has the code length of each id (canonical codes follow from the
lengths). ``blocks`` has a row per block, in ascending doc_id order within a file bucket and over buckets:

    bucket, block        which file bucket, and the block's number in it
    first                ids in the bucket before this block
    doc_ids, n_tokens    of the block's documents, in order
    starts               where each document begins in the payload, in bytes
    checkpoints          for each document, the bit offset in it of every STRIDE-th id (little-endian unsigned 32-bit)
    payload              the codes, most significant bit first, each document from a byte boundary on

A block needs nothing but the code table to be read. Reading decodes all stretches between checkpoints of a block side by
side, a table look-up for each id.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_CHARS, chosen_parts, in_batches, shared_folder, table, take_turn

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LONGEST_CODE = 18
STRIDE = 128
BLOCK_TOKENS = 131_072
DOCS_PER_BUCKET = 20_000
CACHED_PIECES = 800_000
#: Words in one call of the library.
CALL_WORDS = 2000
_SPACE = regex.compile(r"\p{White_Space}+")
_LOWER = "[a-zß-öø-ÿ]+"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Pieces of Latin letters and full stops or commas; their ids are those of the letters in lower case, then of the rest.
_SIMPLE = f"^{_LETTERS}[.,]*$"


class Encoder:
    """Ids of texts. This vocabulary drops white space, so a text's ids are those of its white-space-separated pieces in
    turn; each distinct piece goes through the tokenizers library once while it is remembered.

    Words of Latin letters in lower case go through it without its normaliser and pattern, which leave them as they are, many
    in one call: each word's last token, and no other, is one that ends a word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bytes_as_letters = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        plain = spec | {"normalizer": None, "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_as_letters]}}
        self.words = Tokenizer.from_str(json.dumps(plain))
        ending = spec["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends_word[i] = token.endswith(ending)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters in lower case."""
        if not words:
            return []
        calls = [" ".join(words[i : i + CALL_WORDS]) for i in range(0, len(words), CALL_WORDS)]
        ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(x.ids, "<u4") for x in self.words.encode_batch_fast(calls, add_special_tokens=False)]])
        ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _of_others(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, distinct: pa.Array) -> list[bytes]:
        """Ids of distinct pieces; those of letters are in lower case."""
        if len(self.new) > CACHED_PIECES // 2:  # the older generation goes; what is still in use moves on
            self.old, self.new = self.new, {}
        pieces = distinct.to_pylist()
        found = list(map(self.new.get, pieces))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        learnt = [pieces[i] for i in gaps]
        for i, ids in zip(gaps, map(self.old.get, learnt), strict=True):
            found[i] = ids
        is_word = pc.match_substring_regex(distinct, f"^{_LOWER}$").to_pylist()
        missing = [i for i in gaps if found[i] is None]
        words, others = [i for i in missing if is_word[i]], [i for i in missing if not is_word[i]]
        for some, of in ((words, self._of_words), (others, self._of_others)):
            for i, ids in zip(some, of([pieces[i] for i in some]), strict=True):
                found[i] = ids
        self.new.update(zip(learnt, [found[i] for i in gaps], strict=True))
        return found

    def _chosen(self, pieces: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of these numbers, side by side, and where each piece's end; pieces are distinct."""
        simple = pc.match_substring_regex(pieces, _SIMPLE)
        cores = pc.if_else(simple, pc.utf8_rtrim(pc.utf8_lower(pieces), characters=".,"), pieces).dictionary_encode()
        rests = pc.if_else(simple, pc.replace_substring_regex(pieces, f"^{_LETTERS}", ""), "").dictionary_encode()
        parts = self._ids(cores.dictionary) + self._ids(rests.dictionary)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        both = np.stack([cores.indices.to_numpy(), rests.indices.to_numpy() + len(cores.dictionary)], axis=1).reshape(-1)
        flat, ends = chosen_parts(np.frombuffer(b"".join(parts), "<u4"), sizes, both)
        return chosen_parts(flat, np.diff(ends[1::2], prepend=0), which)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and how many each text has; null counts as empty."""
        # white space is what Unicode calls so; Arrow counts some control characters too
        whole = pc.fill_null(pa.array(texts, pa.large_string()), "")
        is_odd = pc.match_substring_regex(whole, r"[\x{1c}-\x{1f}]")
        odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False)).tolist()
        lists = pc.utf8_split_whitespace(pc.if_else(is_odd, "", whole) if odd else whole)
        coded = lists.flatten().dictionary_encode()
        flat, ends = self._chosen(coded.dictionary, coded.indices.to_numpy())
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        counts = np.diff(edges)
        if odd:
            rows = [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            for i in odd:
                rows[i] = np.frombuffer(b"".join(self._of_others([p for p in _SPACE.split(texts[i]) if p])), "<u4")
            flat, counts = np.concatenate(rows), np.array([len(x) for x in rows])
        return flat, counts


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    take_turn("token_files", _encoder.cache_clear)
    return _encoder(path)


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code with none above ``longest`` (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(weights)
    merged, leaf = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        m = len(merged) // 2
        both = np.concatenate([weights, merged[0 : 2 * m : 2] + merged[1 : 2 * m : 2]])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        leaf.append(at < n)
    take, own = 2 * n - 2, np.zeros(n, np.uint8)
    for flags in reversed(leaf):
        leaves = int(flags[:take].sum())
        own[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = own
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter ones first, equal lengths in order of id."""
    out = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        size = int(lengths[i])
        if not size:
            continue
        code = (code + 1) << (size - before) if before else 0
        out[i], before = code, size
    return out


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, np.ndarray, list[bytes]]:
    """The bits of some documents with these numbers of ids, where each begins in bytes, and each one's checkpoints."""
    sizes = lengths[ids].astype(np.int64)
    if not sizes.all():
        raise ValueError("an id has no code")
    edges = np.concatenate([[0], np.cumsum(counts)])
    bits = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.cumsum((np.diff(bits[edges]) + 7) // 8)
    starts, total = np.concatenate([[0], starts[:-1]]), int(starts[-1]) if len(starts) else 0
    inside = bits[:-1] - np.repeat(bits[edges[:-1]], counts)
    at = inside + np.repeat(8 * starts, counts)
    # a code starts in a 32-bit word and may run over into the next: the words' two shares are sums of disjoint bits
    placed = words[ids].astype(np.uint64) << (64 - sizes - (at & 31)).astype(np.uint64)
    word = at >> 5
    out = np.zeros((total + 3) // 4 + 1, np.uint64)
    if len(ids):
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out[word[first]] = np.add.reduceat(placed >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    marked = (np.arange(len(ids)) - np.repeat(edges[:-1], counts)) % STRIDE == 0
    marks, ends = inside[marked].astype("<u4").tobytes(), (4 * np.cumsum(-(-counts // STRIDE))).tolist()
    return out.astype(">u4").tobytes()[:total], starts, [marks[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def reading_table(lengths: np.ndarray) -> np.ndarray:
    """For each string of LONGEST_CODE bits: the id that its start is the code of, times 32, plus the code's length."""
    out = np.zeros(1 << LONGEST_CODE, np.uint32)
    place = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if size := int(lengths[i]):
            out[place : place + (1 << (LONGEST_CODE - size))] = i << 5 | size
            place += 1 << (LONGEST_CODE - size)
    return out


def unpack(payload: bytes, starts: np.ndarray, counts: np.ndarray, checkpoints: list[bytes], reading: np.ndarray) -> list[np.ndarray]:
    """The ids of each document of a block."""
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    offsets = [np.frombuffer(c, "<u4").astype(np.int64) for c in checkpoints]
    lanes = np.array([len(o) for o in offsets])
    at = np.concatenate([np.zeros(0, np.int64), *[o + 8 * s for o, s in zip(offsets, starts.tolist(), strict=True)]])
    left = np.concatenate([np.zeros(0, np.int64), *[np.minimum(STRIDE, c - STRIDE * np.arange(k)) for c, k in zip(counts.tolist(), lanes.tolist(), strict=True)]])
    order = np.argsort(-left, kind="stable")
    at, remaining = at[order], left[order]
    found = np.zeros((STRIDE, len(at)), np.uint32)
    for step in range(int(remaining[0]) if len(remaining) else 0):
        n = int(np.searchsorted(-remaining, -step))  # lanes with more than step ids
        now = at[:n]
        entry = reading[((windows[now >> 3] << (now & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)) >> np.uint32(32 - LONGEST_CODE)]
        found[step, :n] = entry >> 5
        at[:n] = now + (entry & 31)
    rows = np.empty((len(at), STRIDE), np.uint32)
    rows[order] = found.T
    edges = np.concatenate([[0], np.cumsum(lanes)])
    return [rows[a:b].reshape(-1)[:c] for a, b, c in zip(edges[:-1].tolist(), edges[1:].tolist(), counts.tolist(), strict=True)]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, counted_ids, counts): the ids of each document with its end id, packed; and, in a row for each
    partition, how often each id occurs there (those rows have no ``ids``). Texts are tokenised where they lie, once."""
    size = encoder(path).library.get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            at = 0
            for part in in_batches(batch["text"], 2 * BATCH_CHARS):
                ids, counts = encoder(path).encode(part)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                total += np.bincount(ids, minlength=size)
                small, edges = ids.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(counts + 1)]) * np.dtype(kind).itemsize
                packed = [small[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(part)].astype("Int64"), "ids": packed, "counted_ids": None, "counts": None})
                at += len(part)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "ids": None, "counted_ids": [used.astype(np.int32)], "counts": [total[used]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary, counted_ids array<int>, counts array<long>")


def token_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the corpus: the partitions' counts, summed; a row per id of the vocabulary comes here."""
    each = rows.filter("counts is not null").select(F.explode(F.arrays_zip("counted_ids", "counts")).alias("c"))
    out = np.zeros(size, np.int64)
    for row in each.groupBy("c.counted_ids").agg(F.sum("c.counts").alias("n")).collect():
        out[row["counted_ids"]] = row["n"]
    return out


_BLOCK = "bucket int, block int, first long, doc_ids array<long>, n_tokens array<int>, starts array<int>, checkpoints array<binary>, payload binary"


def _blocks(batches: Iterator[pd.DataFrame], kind: str, lengths: np.ndarray, words: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, ids) in order of document become the blocks of a bucket, which is the partition."""
    take_turn("token_blocks")  # all texts are tokenised: the words needn't be kept
    bucket = TaskContext.get().partitionId()
    number, first, size, rows = 0, 0, 0, []

    def block() -> pd.DataFrame:
        raw = [np.frombuffer(ids, kind) for _, ids in rows]
        counts = np.array([len(x) for x in raw])
        payload, starts, marks = pack(np.concatenate(raw), counts, lengths, words)
        docs = np.array([None if d is pd.NA or d != d else int(d) for d, _ in rows], object)
        return pd.DataFrame([(bucket, number, first, docs, counts.astype(np.int32), starts.astype(np.int32), marks, payload)], columns=[x.split()[0] for x in _BLOCK.split(", ")])

    for batch in batches:
        for row in zip(batch["doc_id"], batch["ids"], strict=True):
            rows.append(row)
            size += len(row[1]) // np.dtype(kind).itemsize
            if size >= BLOCK_TOKENS:
                yield block()
                number, first, size, rows = number + 1, first + size, 0, []
    if rows:
        yield block()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, into ``folder`` in ascending doc_id order.

    Null and empty texts have the end id only; null ids come first; repeated ids are in order of their number of ids and
    checksum. An empty table gives empty tables. Other columns are ignored. Texts are tokenised where they lie, once, into a
    table of ids, which is then dealt by ranges of doc_id into buckets of about as many documents and coded there.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    size = encoder(path).library.get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    kept = shared_folder(spark, "token-ids")
    tokenised(docs, path, end_id).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.parquet(kept)
    lengths = code_lengths(token_counts(ids, size))
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{folder}/code")
    words = codes(lengths)
    rows = ids.filter("counts is null").select("doc_id", "ids")
    buckets = max(1, -(-rows.count() // DOCS_PER_BUCKET))
    order = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(buckets, order).sortWithinPartitions(order, F.octet_length("ids"), F.crc32("ids"))
    dealt.mapInPandas(lambda batches: _blocks(batches, kind, lengths, words), _BLOCK).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) from a written folder; start counts all ids before the document."""
    lengths = np.zeros(0, np.uint8)
    if rows := spark.read.parquet(f"{folder}/code").collect():  # a row per id of the vocabulary at most
        lengths = np.zeros(max(r["id"] for r in rows) + 1, np.uint8)
        for r in rows:
            lengths[r["id"]] = r["length"]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_turn("token_blocks")
        reading = reading_table(lengths)
        for batch in batches:
            for bucket, first, ids, counts, starts, marks, payload in zip(*[batch[c] for c in ("bucket", "first", "doc_ids", "n_tokens", "starts", "checkpoints", "payload")], strict=True):
                counts = np.asarray(counts, np.int64)
                found = unpack(payload, np.asarray(starts, np.int64), counts, list(marks), reading)
                before = first + np.concatenate([[0], np.cumsum(counts)[:-1]])
                yield pd.DataFrame({"bucket": bucket, "doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], "Int64"), "within": before, "n_tokens": counts, "token_ids": [x.astype("<u4").tobytes() for x in found]})

    blocks = spark.read.parquet(f"{folder}/blocks")
    sums = blocks.select("bucket", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    ahead = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row per bucket
    # ``ahead`` has a row of two numbers for each partition of the writing job
    rows = blocks.mapInPandas(documents, "bucket int, doc_id long, within long, n_tokens long, token_ids binary")
    return rows.join(F.broadcast(ahead), "bucket").select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "token_ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
