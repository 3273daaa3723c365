"""Exact self-join of documents by the Jaccard similarity of their word shingles, with signature trees.

1. A text is turned into its set of shingle hashes. The hashes are dealt into buckets by range, four bytes each, where it is counted
   in how many different sets each occurs. A set that links must share SIMILARITY_PERCENT of its shingles with others, so one
   with fewer shingles that occur elsewhere goes: it stands alone. Only the others' texts are read again.
2. From here on a set is its shingles that occur elsewhere, rarest first, beside the size of the whole. Two linked sets share
   one of their first m - ceil(s n) + 1 shingles at a similarity of s (m of n occur elsewhere). Each of these is a region; regions with the same
   members are one.
3. Members of a region stand in blocks of bounded size, by their smallest hash. A block holds a signature tree: sets are sorted
   so that like ones are side by side, and each node holds the OR of its members' token bitmaps, the range of their sizes and
   the components that they belong to. A dual traversal goes down pairs of nodes and drops those whose members can't overlap
   enough, or are linked already. What is left are pairs of sets, compared in full.
   Blocks are nodes of the same kind, so pairs of blocks are dropped by the same bounds before any set is moved.
4. Large groups of near copies would make many pairs that are links anyway. So sets are first linked within the region of their
   commonest shingle, then one of each component in regions, and only then all that still differ in component. The
   last step covers all pairs that share a region, so no link is lost: small regions give pairs by their signatures, which are
   compared once for all regions; in large ones whole sets are compared block by block, and nothing but links leaves a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, take_turn
from .components import connected_components
from .ranked_search import packed, unpacked
from .shingling import shingles

SIMILARITY_PERCENT = 80
#: Buckets of hashes: at least so many, more where a bucket would have more characters of the corpus than these (some six make
#: a shingle). Documents go to buckets in packs.
BUCKETS = 32
BUCKET_CHARS = 36_000_000
PACK_ROWS = 1000
PACK_SHINGLES = 500_000
#: Longs of a bitmap, and what a block of a region holds at most, but for single sets that are larger.
WORDS = 16
BLOCK_ROWS = 2000
BLOCK_SHINGLES = 1_000_000
#: Regions up to this size give pairs, which are compared once however many regions find them; partners of a set in a group.
SMALL_REGION = 64
PARTNERS = 500
#: Pairs of nodes that are looked at together.
PAIRS = 200_000
FANOUT = 4

_PACKED = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("who", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("values", pa.binary())])
_PACKED_SQL = "batch long, bucket int, ids array<long>, ns array<long>, who binary, keys binary, sizes binary, values binary"
_FOUND = pa.list_(pa.struct([("bucket", pa.int32()), ("counts", pa.binary())]))
_SURVIVING = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("found", _FOUND)])
_SURVIVING_SQL = "doc_id long, n long, k1 long, k2 long, found array<struct<bucket:int,counts:binary>>"
_MEMBERS = "rep long, n long, m long, slack long, least double, top long, prefix array<long>, bits array<long>, tokens binary"
_FACTORS = np.random.default_rng(20240401).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _residue(tokens: np.ndarray) -> np.ndarray:
    """Four bytes that tell hashes of a bucket apart; two that fall together are at worst taken as one that occurs in both sets."""
    return tokens.astype(np.uint32)


def _key(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def _packs(number: int, ids: list[int | None], sets: list[np.ndarray], buckets: int) -> list[dict]:
    """The rows of some documents: one of the documents, and one for each bucket with all their hashes in it, side by side."""
    keys = [_key(s) if len(s) else (0, 0) for s in sets]
    head = {"batch": number, "bucket": -1 - number % buckets, "ids": ids, "ns": [len(s) for s in sets], "keys": np.array(keys, np.int64).tobytes()}
    used = [i for i, s in enumerate(sets) if len(s) and ids[i] is not None]
    if not used:
        return [head]
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.array(used, np.int32), [len(sets[i]) for i in used])
    bucket = _bucket(flat, buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")  # then by document, then by hash
    flat, owner, bucket = _residue(flat[order]), owner[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    rows, key_of = [head], np.array(keys, np.int64)
    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if e > s:
            starts = np.flatnonzero(np.diff(owner[s:e], prepend=-1))
            who = owner[s:e][starts]
            # eight bytes of the key tell the sets of a bucket apart
            rows.append({"batch": number, "bucket": k, "who": who.astype(np.uint16).tobytes(), "keys": key_of[who, 0].tobytes(), "sizes": packed(np.diff(np.append(starts, e - s)))[0].tobytes(), "values": flat[s:e].tobytes()})
    return rows


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    take_turn("jaccard_join")
    number = TaskContext.get().partitionId() << 32
    ids, sets, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            sets.append(shingles(text.as_py()))
            size += len(sets[-1])
            if len(ids) >= PACK_ROWS or size >= PACK_SHINGLES:
                yield pa.RecordBatch.from_pylist(_packs(number, ids, sets, buckets), _PACKED)
                ids, sets, size, number = [], [], 0, number + 1
    if ids:
        yield pa.RecordBatch.from_pylist(_packs(number, ids, sets, buckets), _PACKED)


def _occurring(bucket: pa.Table) -> pa.Table:
    """For each set's hashes of a bucket: in how many sets each occurs (16 bits, more counts as 65535); sets without one that
    occurs twice are left out. Equal sets count once. Rows of documents pass."""
    if bucket.column("bucket")[0].as_py() < 0:
        return bucket
    rows = bucket.select(["batch", "bucket", "who", "keys", "sizes", "values"]).to_pylist()
    who, keys = ([np.frombuffer(r[c], d) for r in rows] for c, d in (("who", np.uint16), ("keys", np.int64)))
    owners = np.cumsum([0, *map(len, who)])
    size, key = np.concatenate([unpacked(np.frombuffer(r["sizes"], np.uint8)) for r in rows]), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    values, at = np.unique(np.concatenate([np.frombuffer(r["values"], np.uint32) for r in rows]), return_inverse=True)
    often = np.bincount(at[~np.repeat(again, size)], minlength=len(values))
    counts = np.minimum(often, 65535).astype(np.uint16)[at]
    ends = np.cumsum(size)
    shared = np.add.reduceat(counts > 1, ends - size, dtype=np.int64)
    kept = shared > 0
    counts = counts[np.repeat(kept, size)]
    cuts = np.concatenate([[0], np.cumsum(np.where(kept, size, 0))])
    out = []
    for row, mine, s, e in zip(rows, who, owners[:-1].tolist(), owners[1:].tolist(), strict=True):
        if kept[s:e].any():
            out.append({"batch": row["batch"], "bucket": row["bucket"], "who": mine[kept[s:e]].tobytes(), "keys": packed(shared[s:e][kept[s:e]])[0].tobytes(), "sizes": packed(size[s:e][kept[s:e]])[0].tobytes(), "values": counts[cuts[s] : cuts[e]].tobytes()})
    return pa.Table.from_pylist(out, _PACKED)


def _surviving(batch: pa.Table, percent: int) -> pa.Table:
    """A row for each document of a batch; ``found`` (bucket, counts of its hashes) only where enough of them occur elsewhere."""
    rows = batch.to_pylist()
    head = next(r for r in rows if r["bucket"] < 0)
    ns = np.array(head["ns"], np.int64)
    keys = np.frombuffer(head["keys"], np.int64).reshape(-1, 2)
    total = np.zeros(len(ns), np.int64)
    pieces = [(r["bucket"], np.frombuffer(r["who"], np.uint16), *(unpacked(np.frombuffer(r[c], np.uint8)) for c in ("keys", "sizes")), r["values"]) for r in rows if r["bucket"] >= 0]
    for _, who, shared, _, _ in pieces:
        total[who] += shared
    enough = (100 * total >= percent * ns) & (ns > 0)
    found: dict[int, list[dict]] = {}
    for bucket, who, _, sizes, values in pieces:
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(enough[who]).tolist():
            found.setdefault(int(who[i]), []).append({"bucket": bucket, "counts": values[2 * int(ends[i] - sizes[i]) : 2 * int(ends[i])]})
    out = [{"doc_id": d, "n": n, "k1": k[0] if n else None, "k2": k[1] if n else None, "found": found.get(i)} for i, (d, n, k) in enumerate(zip(head["ids"], ns.tolist(), keys.tolist(), strict=True))]
    return pa.Table.from_pylist(out, _SURVIVING)


def _bits(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(WORDS, np.uint64)
    place = tokens % np.uint64(64 * WORDS)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def _members(batches: Iterator[pd.DataFrame], buckets: int, percent: int) -> Iterator[pd.DataFrame]:
    """The sets that may link, of (rep, k1, k2, n, text, found: list of (bucket, counts))."""
    take_turn("jaccard_join")
    for batch in batches:
        out = []
        for row in batch.itertuples():
            tokens = shingles(row.text)
            if not len(tokens) or _key(tokens) != (row.k1, row.k2):
                continue  # another text of a document id
            counts = np.ones(len(tokens), np.int64)
            edges = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1, dtype=np.uint64))
            for piece in row.found:
                counts[edges[piece["bucket"]] : edges[piece["bucket"] + 1]] = np.frombuffer(piece["counts"], np.uint16)
            own = tokens[counts > 1]
            counts = counts[counts > 1]
            n, m = len(tokens), len(own)
            first = np.lexsort((own, counts))[: m - (percent * n + 99) // 100 + 1]
            top = own[first[np.lexsort((own[first], -counts[first]))[0]]]
            bits = _bits(own)
            # where the smallest of m hashes is expected to lie, as a share
            least = 1 - (1 - int(own[0]) / 2.0**64) ** m
            out.append((row.rep, n, m, m - int(np.bitwise_count(bits).sum()), least, int(top.view(np.int64)), own[first].view(np.int64), bits.view(np.int64), own.tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _MEMBERS.split(", ")])


class _Sets:
    """The sets of a group, their components so far, and the links that are found."""

    def __init__(self, group: pd.DataFrame, percent: int) -> None:
        self.percent = percent
        self.reps, self.n, self.m, self.slack = (group[c].to_numpy() for c in ("rep", "n", "m", "slack"))
        self.tokens = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
        self.bits = np.stack(group["bits"].to_numpy()).astype(np.int64).view(np.uint64)
        self.names, self.comp = np.unique(group["comp"].to_numpy(), return_inverse=True)
        self.root = list(range(len(self.names)))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def compare(self, i: int, others: list[int]) -> None:
        """Links i with those of the others that are near and not of its component yet."""
        for start in range(0, len(others), 64):
            own = self.find(self.comp[i])
            block = [j for j in others[start : start + 64] if self.find(self.comp[j]) != own]
            if not block:
                continue
            sizes = self.m[block]
            joined = np.concatenate([self.tokens[j] for j in block])
            at = np.minimum(np.searchsorted(self.tokens[i], joined), self.m[i] - 1)
            shared = np.add.reduceat((self.tokens[i][at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
            for j in np.array(block)[100 * shared >= self.percent * (self.n[i] + self.n[block] - shared)].tolist():
                x, y = self.find(self.comp[i]), self.find(self.comp[j])
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.links.append((int(self.reps[i]), int(self.reps[j])))


def _neighbours(sets: _Sets) -> np.ndarray:
    """Compares sets that stand side by side in some orders by smallest hash; gives an order with like sets together."""
    flat = np.concatenate(sets.tokens)
    starts = np.cumsum(sets.m) - sets.m
    least = [np.minimum.reduceat(flat * f ^ (flat >> np.uint64(31)), starts) for f in _FACTORS]
    for k in range(len(least)):
        order = np.lexsort((least[k - 1], least[k]))
        same = np.flatnonzero(least[k][order[1:]] == least[k][order[:-1]])
        for a, b in zip(order[same].tolist(), order[same + 1].tolist(), strict=True):
            sets.compare(a, [b])
    return np.lexsort((sets.n, least[1], least[0]))


def _tree(bits: np.ndarray, n: np.ndarray, m: np.ndarray, slack: np.ndarray, comp: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The levels of the signature tree of sets in their order, leaves (the sets) first."""
    level = {"bits": bits, "least_n": n, "most_n": n, "m": m, "slack": slack, "low": comp, "high": comp}
    levels = [level]
    how = {"bits": np.bitwise_or, "least_n": np.minimum, "most_n": np.maximum, "m": np.maximum, "slack": np.maximum, "low": np.minimum, "high": np.maximum}
    while len(level["m"]) > FANOUT:
        starts = np.arange(0, len(level["m"]), FANOUT)
        level = {name: how[name].reduceat(values, starts) for name, values in level.items()}
        levels.append(level)
    return levels


def _may_link(level: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members of two nodes can overlap enough and differ in component."""
    overlap = np.bitwise_count(level["bits"][i] & level["bits"][j]).sum(1, dtype=np.int64) + np.minimum(level["slack"][i], level["slack"][j])
    overlap = np.minimum(overlap, np.minimum(level["m"][i], level["m"][j]))
    fits = (100 + percent) * overlap >= percent * (level["least_n"][i] + level["least_n"][j])
    fits &= (100 * level["most_n"][i] >= percent * level["least_n"][j]) & (100 * level["most_n"][j] >= percent * level["least_n"][i])
    return fits & ~((level["low"][i] == level["high"][i]) & (level["low"][j] == level["high"][j]) & (level["low"][i] == level["low"][j]))


def _traverse(levels: list[dict[str, np.ndarray]], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The dual traversal of a tree with itself: (i, j) of leaves that may link, i before j, some at a time."""
    i, j = np.triu_indices(len(levels[-1]["m"]))
    stack = [(len(levels) - 1, i, j)]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > PAIRS:
            stack += [(depth, i[s : s + PAIRS], j[s : s + PAIRS]) for s in range(0, len(i), PAIRS)]
            continue
        fits = _may_link(levels[depth], i, j, percent) & ((i < j) | (depth > 0))
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if depth == 0:
            yield i, j
            continue
        below = len(levels[depth - 1]["m"])
        a, b = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT)))
        i, j = (FANOUT * i[:, None] + a).ravel(), (FANOUT * j[:, None] + b).ravel()
        inside = (i <= j) & (j < below)
        stack.append((depth - 1, i[inside], j[inside]))


def _by_first(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    cuts = np.flatnonzero(np.diff(i, prepend=-1))
    for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(i)).tolist(), strict=True):
        yield int(i[s]), j[s:e].tolist()


def _linked(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that tie together what links within a group, or between its two blocks, joins."""
    take_turn("jaccard_join")
    group = group.drop_duplicates(["rep", "tokens"]).reset_index(drop=True)
    sets = _Sets(group, percent)
    if len(sets.reps) > 1:
        order = _neighbours(sets)
        side = group["block"].to_numpy()[order]
        comp = np.array([sets.find(c) for c in sets.comp[order].tolist()])
        for i, j in _traverse(_tree(sets.bits[order], sets.n[order], sets.m[order], sets.slack[order], comp), percent):
            if (side != side[0]).any():
                i, j = i[side[i] != side[j]], j[side[i] != side[j]]
            if len(i):
                for one, others in _by_first(order[i], order[j]):
                    sets.compare(one, others)
    return pd.DataFrame(sets.links, columns=["a", "b"], dtype=np.int64)


def _candidates(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of a small region that may link by their signatures."""
    group = group.sort_values(["least", "n"])
    reps, n, m, slack, comp = (group[c].to_numpy() for c in ("rep", "n", "m", "slack", "comp"))
    levels = _tree(np.stack(group["bits"].to_numpy()).astype(np.int64).view(np.uint64), n, m, slack, comp)
    found = [(np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j])) for i, j in _traverse(levels, percent)]
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pd.DataFrame({"a": a, "b": b})


def _confirmed(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a set and its partners (the set itself has b = a): the pairs that link."""
    take_turn("jaccard_join")
    own = group[group["a"] == group["b"]]
    out = []
    for n, held in zip(own["n"], own["tokens"], strict=True):
        mine = np.frombuffer(held, np.uint64)
        for row in group[group["a"] != group["b"]].itertuples():
            theirs = np.frombuffer(row.tokens, np.uint64)
            shared = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum())
            if 100 * shared >= percent * (n + row.n - shared):
                out.append((row.a, row.b))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (region, rep, comp, m, least) with ``block``: parts of bounded size, by smallest hash, and by a hash of the member
    where many have the same smallest one."""
    parts = lambda: F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("m") / BLOCK_SHINGLES)).cast("long")
    whole = rows.groupBy("region").agg(parts().alias("parts"), F.count("*").alias("members")).filter("members > 1").drop("members")
    keyed = rows.join(whole, "region").withColumn("place", F.floor(F.col("least") * F.col("parts")))
    crowd = keyed.filter("parts > 1").groupBy("region", "place").agg(parts().alias("shares"))
    dealt = keyed.join(crowd, ["region", "place"], "left")
    salt = F.pmod(F.xxhash64("rep", F.lit(3)), F.coalesce("shares", F.lit(1).cast("long")))
    return dealt.select("region", "rep", "comp", F.when(F.col("parts") == 1, F.lit(0).cast("long")).otherwise(F.xxhash64("place", salt)).alias("block"))


def _within(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links within the blocks of the regions of ``rows`` (region, rep, comp)."""
    # stored, so that Spark knows its size: where it is small it is broadcast, and sets move once, to their region
    dealt = stored(_blocks(rows.join(members.select("rep", "m", "least"), "rep")), "jaccard-blocks")
    beside = dealt.join(members.select("rep", "n", "m", "slack", "bits", "tokens"), "rep")
    return beside.groupBy("region", "block").applyInPandas(lambda group: _linked(group, percent), "a long, b long")


def _bounds(rows: DataFrame) -> DataFrame:
    """Blocks as nodes of a signature tree; rows: region, block, comp, n, m, slack, bits."""
    bits = [F.bit_or(F.col("bits")[i]).alias(f"w{i}") for i in range(WORDS)]
    ends = [F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("m").alias("m"), F.max("slack").alias("slack"), F.min("comp").alias("low"), F.max("comp").alias("high")]
    return rows.groupBy("region", "block").agg(*ends, *bits)


def _fitting(x: str, y: str, percent: int) -> Column:
    """As _may_link, for two blocks."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = sum((F.bit_count(c(x, f"w{i}").bitwiseAND(c(y, f"w{i}"))) for i in range(1, WORDS)), F.bit_count(c(x, "w0").bitwiseAND(c(y, "w0"))))
    overlap = F.least(both + F.least(c(x, "slack"), c(y, "slack")), c(x, "m"), c(y, "m"))
    fits = ((100 + percent) * overlap >= percent * (c(x, "least_n") + c(y, "least_n"))) & (100 * c(x, "most_n") >= percent * c(y, "least_n")) & (100 * c(y, "most_n") >= percent * c(x, "least_n"))
    return fits & ~((c(x, "low") == c(x, "high")) & (c(y, "low") == c(y, "high")) & (c(x, "low") == c(y, "low")))


def _across(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links within and between the blocks of the regions of ``rows`` (region, rep, comp)."""
    dealt = stored(_blocks(rows.join(members.select("rep", "m", "least"), "rep")), "jaccard-blocks")
    nodes = stored(_bounds(dealt.join(members.select("rep", "n", "m", "slack", "bits"), "rep")), "jaccard-nodes")
    x, y = nodes.alias("x"), nodes.alias("y")
    pairs = x.join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.block") <= F.col("y.block"))).filter(_fitting("x", "y", percent))
    pairs = pairs.select(F.col("x.region").alias("region"), F.col("x.block").alias("one"), F.col("y.block").alias("other"))
    asked = pairs.select("region", "one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))
    placed = stored(dealt.join(asked, ["region", "block"]), "jaccard-pairs")
    beside = placed.join(members.select("rep", "n", "m", "slack", "bits", "tokens"), "rep")
    return beside.groupBy("region", "one", "other").applyInPandas(lambda group: _linked(group, percent), "a long, b long")


def _pairwise(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links within the small regions of ``rows`` (region, rep, comp): signatures alone go to the regions, pairs that several
    regions find are compared once."""
    signed = rows.join(members.select("rep", "n", "m", "slack", "least", "bits"), "rep")
    pairs = stored(signed.groupBy("region").applyInPandas(lambda region: _candidates(region, percent), "a long, b long").distinct(), "jaccard-pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    own = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asked = stored(dealt.unionByName(own), "jaccard-asked")
    beside = asked.join(members.select(F.col("rep").alias("b"), "n", "tokens"), "b")
    return beside.groupBy("a", "part").applyInPandas(lambda group: _confirmed(group, percent), "a long, b long")


def _all_links(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All links between different components within the regions of ``rows``, by the size of the region."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("size"))
    sized = stored(rows.join(sizes, "region"), "jaccard-regions")
    small = F.col("size") <= SMALL_REGION
    found = _pairwise(sized.filter(small).drop("size"), members, percent)
    large = sized.filter(~small).drop("size")
    return found if large.isEmpty() else found.unionByName(_across(large, members, percent))


def _with_components(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return rows.withColumn("comp", F.col("rep"))
    found = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("c"))
    return rows.join(found, "rep", "left").withColumn("comp", F.coalesce("c", "rep")).drop("c")


def _one_of_like(rows: DataFrame, what: str) -> DataFrame:
    """The rows of one region of those that hold the same values of a column, each value in a row of its own; regions with one value
    are left out."""
    marks = rows.groupBy("region").agg(F.count("*").alias("size"), F.sum(F.xxhash64(what, F.lit(1)) % (1 << 40)).alias("h1"), F.bit_xor(F.xxhash64(what, F.lit(2))).alias("h2"))
    one = marks.filter("size > 1").groupBy("size", "h1", "h2").agg(F.min("region").alias("region")).select("region")
    return rows.join(one, "region")


def _mixed(rows: DataFrame) -> DataFrame:
    """The regions of ``rows`` (region, rep, comp) whose members differ in component; of those with the same members one."""
    differ = rows.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("region")
    return _one_of_like(rows.join(differ, "region"), "rep")


def sets_that_may_link(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, k1, k2) for each row, with the size and key of its set; the sets that may link, see _MEMBERS)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(BUCKETS, -(-chars // BUCKET_CHARS)))
    dealt = texts.mapInArrow(lambda batches: _dealt(batches, buckets), _PACKED_SQL)
    counted = dealt.groupBy("bucket").applyInArrow(_occurring, _PACKED_SQL)
    found = stored(counted.groupBy("batch").applyInArrow(lambda batch: _surviving(batch, percent), _SURVIVING_SQL), "jaccard-documents")
    features = found.select("doc_id", "n", "k1", "k2")
    kept = found.filter("found is not null").groupBy("k1", "k2").agg(F.min_by(F.struct("doc_id", "n", "found"), "doc_id").alias("d"))
    asked = kept.select("k1", "k2", F.col("d.doc_id").alias("rep"), F.col("d.n").alias("n"), F.col("d.found").alias("found"))
    reps = stored(asked.select("rep"), "jaccard-reps")
    # only the texts of these documents move
    whole = texts.filter("text is not null").join(reps, F.col("doc_id") == F.col("rep"), "left_semi").join(asked, F.col("doc_id") == F.col("rep")).select("rep", "k1", "k2", "n", "text", "found")
    return features, stored(whole.mapInPandas(lambda batches: _members(batches, buckets, percent), _MEMBERS), "jaccard-members")


def remaining_links(members: DataFrame, known: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(a, b): the links among the sets between what ``known`` links (a, b) leave in different components."""
    rows = members.select("rep", F.explode("prefix").alias("region")).distinct()
    return _all_links(stored(_mixed(_with_components(rows, known)), "jaccard-mixed"), members, percent)


def links(members: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(a, b): links whose components are those of all links among the sets."""
    first = stored(_within(members.select(F.col("top").alias("region"), "rep", F.col("rep").alias("comp")), members, percent), "jaccard-links")
    rows = members.select("rep", F.explode("prefix").alias("region")).distinct()
    heads = _with_components(rows, first).groupBy("region", "comp").agg(F.min("rep").alias("rep"))
    second = stored(first.unionByName(_within(_one_of_like(heads, "comp"), members, percent)), "jaccard-links")
    return second.unionByName(remaining_links(members, second, percent))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs`` (doc_id, text; further columns are not read).

    Documents link where 100 * shared shingles >= 80 * all shingles of both; the component is the smallest doc_id that links
    reach. Null and wordless texts have no shingle and stand alone. Rows that share a doc_id count as one document with
    several texts. A row with a null doc_id is linked with nothing: its component is null. An empty table gives an empty result.
    """
    features, members = sets_that_may_link(docs)
    linked = connected_components(links(members), "a", "b").select(F.col("node").alias("rep"), "component")
    classes = features.filter("doc_id is not null and k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    named = classes.join(linked, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    # a document with several texts joins their classes
    out = features.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS shingle
      FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, l.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""
