"""Byte-level BPE encoding and decoding by a trie of distinct words.

For byte pair encodings in which every token has one merge, the encoding of a prefix is fixed by its last token: it is the
only token that ends the prefix and may stand after the last token of what is left of it. So the distinct words of a batch
are put into a trie, and a depth-first walk hands the last token of each prefix down to its extensions; a prefix that many
words share is worked out once. Beside the last token goes the longest ending of the prefix with which a token begins: it
tells which tokens end there, so a byte costs a look-up or two. A word's encoding is read by going back from its last token.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen_parts, in_batches, table, take_turn

VOCABULARY = "byte_bpe_50k.json"
#: Encoded words that a worker keeps, in two generations of half as many.
CACHED_WORDS = 400_000
CACHED_PAIRS = 2_000_000


#: White space other than single spaces and newlines.
_ODD_SPACE = r"[ \n]{2}|[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: a printable byte stands for itself, the
    others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def trie(words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
    """Distinct words as a trie in depth-first order: each with the depth at which it leaves the path of the one before.
    A trie of nodes would take some hundred bytes for each byte of a word; this takes none but the words."""
    before = b""
    for word in sorted(words):
        if word.startswith(before):
            shared = len(before)
        else:
            size = min(len(before), len(word))
            apart = int.from_bytes(before[:size], "big") ^ int.from_bytes(word[:size], "big")
            shared = size - (apart.bit_length() + 7) // 8
        yield word, shared
        before = word


def gathered(parts: list[bytes], which: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each stretch of ``which`` between edges, the parts of these numbers, joined; parts hold 32-bit integers."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    flat, ends = chosen_parts(np.frombuffer(b"".join(parts), "<u4"), sizes, which)
    joined = flat.tobytes()
    cuts = (np.concatenate([[0], ends])[edges] << 2).tolist()
    return [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Codec:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        # the halves of a token and its rank; a single byte has no halves and ranks before all merges
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            pair = self.ids[to_bytes(a)], self.ids[to_bytes(b)]
            made = self.ids[to_bytes(a) + to_bytes(b)]
            self.merged[pair], self.halves[made], self.rank[made] = made, pair, rank
        # for each token, the tokens before it that are known to leave it standing, or not; -1 is the start of a word
        self.befores: list[dict[int, bool]] = [{-1: True} for _ in self.pieces]
        self.pairs = 0
        self.sizes = list(map(len, self.pieces))
        self._find_endings()
        self.words = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        # ids of pieces: a piece stands for itself after a space, or, where it begins with a newline, for that and the rest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def stands(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens together gives just these two tokens.

        Takes the tokens apart again, the latest merge first; they stand unless a merge across the seam would have come
        before the merges that made its neighbours.
        """
        a, b, bound, ok = left, right, float("inf"), True
        while True:
            across = self.merged.get((a, b))
            if across is not None and self.rank[across] < bound:
                ok = False
                break
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                break
            # the later of the two merges is undone; merges of equal rank run from the left
            if rank_a > rank_b:
                bound, a = rank_a, self.halves[a][1]
            else:
                bound, b = rank_b + 1, self.halves[b][0]
        if self.pairs > CACHED_PAIRS:
            self.pairs = 0
            for before in self.befores:
                before.clear()
                before[-1] = True
        self.pairs += 1
        self.befores[right][left] = ok
        return ok

    def _find_endings(self) -> None:
        """Numbers the beginnings of tokens. For each: the next ones by byte, the longest shorter ending of it that begins a
        token too, and the tokens that end it, longest first, with their sizes and the tokens known before them."""
        self.next: list[dict[int, int]] = [{}]
        own = {}
        for piece, token in self.ids.items():
            at = 0
            for byte in piece:
                if byte not in self.next[at]:
                    self.next[at][byte] = len(self.next)
                    self.next.append({})
                at = self.next[at][byte]
            own[at] = (token, len(piece), self.befores[token])
        self.shorter = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()] * len(self.next)
        level = [0]
        while level:
            below = []
            for at in level:
                for byte, child in self.next[at].items():
                    short = self.shorter[at]
                    while short and byte not in self.next[short]:
                        short = self.shorter[short]
                    self.shorter[child] = self.next[short].get(byte, 0) if at else 0
                    self.ends[child] = (own[child], *self.ends[self.shorter[child]]) if child in own else self.ends[self.shorter[child]]
                    below.append(child)
            level = below

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct word, as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        stands, sizes, following, shorter, ends = self.stands, self.sizes, self.next, self.shorter, self.ends
        # what the walk hands down: the last token of each prefix on the path, and the longest ending that begins a token
        last: list[int] = [-1]
        endings = [0]
        for word, shared in trie(words):
            del last[shared + 1 :], endings[shared + 1 :]
            at = endings[shared]
            for byte in word[shared:]:
                step = following[at].get(byte)
                while step is None:
                    at = shorter[at]
                    step = following[at].get(byte)  # every byte begins a token
                at = step
                for token, size, before in ends[at]:
                    fits = before.get(last[-size])
                    if fits or (fits is None and stands(last[-size], token)):
                        break
                last.append(token)
                endings.append(at)
            ids, left = [], len(word)
            while left:
                token = last[left]
                ids.append(token)
                left -= sizes[token]
            ids.reverse()
            out[word] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        return out

    def _words(self, piece: str) -> list[bytes]:
        """The words of a piece that isn't letters alone."""
        if piece[:1] == "\n":
            return [b"\n", *([piece[1:].encode()] if piece[1:].isalpha() else [w.encode() for w in self.words.findall(piece[1:])])]
        return [w.encode() for w in self.words.findall(" " + piece)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, by one trie for all of them."""
        letters: list[tuple[int, bytes]] = []
        others: list[tuple[int, list[bytes]]] = []
        for i, piece in enumerate(pieces):
            if piece.isalpha():
                letters.append((i, b" " + piece.encode()))
            else:
                others.append((i, self._words(piece)))
        encoded = self.encode_words({*[word for _, word in letters], *[word for _, own in others for word in own]})
        found = [b""] * len(pieces)
        for i, word in letters:
            found[i] = encoded[word]
        for i, own in others:
            found[i] = b"".join([encoded[word] for word in own])
        return found

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces: those that aren't in the cache are encoded together. When the cache is full, its
        older generation goes and what is still in use moves on."""
        if len(self.new) > CACHED_WORDS // 2:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in gaps:
            found[i] = ids = self.old.get(pieces[i])
            if ids is None:
                unknown.append(i)
        for i, ids in zip(unknown, self.encode_pieces([pieces[i] for i in unknown]), strict=True):
            found[i] = ids
        self.new.update([(pieces[i], found[i]) for i in gaps])
        return found

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Encodes texts without added tokens. Where single spaces and newlines are all the white space, a text's words are
        those of its pieces between them; else the whole text is split by the pattern."""
        out = [b""] * len(texts)
        odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD_SPACE).to_numpy(zero_copy_only=False)).tolist()
        if odd:
            split = [[w.encode() for w in self.words.findall(texts[i])] for i in odd]
            encoded = self.encode_words({w for words in split for w in words})
            for i, words in zip(odd, split, strict=True):
                out[i] = b"".join([encoded[w] for w in words])
        even = sorted(set(range(len(texts))).difference(odd))
        if even:
            # each text begins with a newline, the first of its ids, which is left out again
            lists = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in even], pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            found = self._ids(coded.dictionary.to_pylist())
            rows = gathered(found, coded.indices.to_numpy(), lists.offsets.to_numpy())
            for i, ids in zip(even, rows, strict=True):
                out[i] = ids[4:]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty. An added token's string in a text becomes that token."""
        plain: list[str] = []
        plans: list[list[int | bytes]] = []
        for text in texts:
            plan: list[int | bytes] = []
            start = 0
            for hit in self.special.finditer(text or "") if self.special else ():
                plan += [len(plain), int(self.added[hit[0]]).to_bytes(4, "little")]
                plain.append(text[start : hit.start()])
                start = hit.end()
            plan.append(len(plain))
            plain.append((text or "")[start:])
            plans.append(plan)
        done = self._plain(plain)
        return [b"".join([done[x] if isinstance(x, int) else x for x in plan]) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def codec(path: str) -> Codec:
    """The codec of a file; read once while a worker works for this operator."""
    take_turn("bpe", _codec.cache_clear)
    return _codec(path)


_ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit integers as one binary).

    Null and empty texts have no tokens. Other columns pass through; those named as a result column are replaced. Rows
    stay where they are: nothing is shuffled, and repeated rows are encoded like any.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf(_ENCODED)
    def encode(texts: pd.Series) -> pd.DataFrame:
        found = [x for part in in_batches(texts) for x in codec(path).encode(part)]
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in found], "token_ids": found})

    out = docs.drop("n_tokens", "token_ids").withColumn("_encoded", encode("text"))
    return out.withColumns({c: F.col(f"_encoded.{c}") for c in ("n_tokens", "token_ids")}).drop("_encoded")


def decoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the text of ``token_ids``; null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec(path).decode(x) for x in ids], dtype=object)

    return docs.withColumn("decoded", decode("token_ids"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encodes each text, decodes its ids, and keeps only
    the digests of both, so that neither leaves the worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    kinds = T.StructType([T.StructField(names[0], T.LongType()), *[T.StructField(c, T.StringType()) for c in names[1:]]])

    @F.pandas_udf(kinds)
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for part in in_batches(texts):
            for ids in codec(path).encode(part):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec(path).decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=list(names), dtype=object)

    out = docs.drop(*names).withColumn("_digest", digest("text"))
    return out.withColumns({c: F.col(f"_digest.{c}") for c in names}).drop("_digest")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
