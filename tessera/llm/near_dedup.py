"""Near-duplicate documents: an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

1. A document's set is its distinct word shingles. Documents with equal sets form a class; one of each goes on.
2. A signature has SLOTS minima. It is read in ORDERS orders (rotations), which is like sorting all signatures ORDERS
   times. Signatures that share their first slots in an order lie side by side: they form a region. A region with more
   than REGION_ROWS rows is cut at the next depth, so the depth adapts to how crowded a place is.
   Before the cut its members are set beside a few leaders of the region, which ties most of what is parted together.
3. Within a region, pairs whose signatures agree well enough are candidates. A pair that shares regions in several
   orders is kept in the first of them only.
4. The texts of candidates go to their region, where their full sets are compared; a region with much text is compared
   block by block, each pair of blocks in a group of its own. What leaves a group is a star for each set of linked
   documents, never all pairs.
5. Components of the stars, found by rounds of joins, give each class, and so each document, its component.

A pair with similarity 0.75 is in no common region with a chance of 2e-6 where regions have the first depth (two slots), and
in one without being a candidate with a chance of 2e-6 as well. Where
all its places are cut to a depth it is 0.002 at four, 0.07 at six, 0.26 at eight, 0.69 at twelve, and 0.99 at 24 (simulated).
Therefore the cut is not relied upon: all members of regions that are crowded at the first depth also go through the exact join
(jaccard_join, with this similarity), which compares what the forest and the leaders left apart. So the links among them are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard_join
from .common import stored, table, take_turn
from .components import connected_components
from .shingling import shingles

SLOTS = 64
ORDERS = 16
DEPTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
REGION_ROWS = 2048
SIMILARITY_PERCENT = 75
#: Slots that must agree before full sets are compared. At similarity 0.75 fewer do with a chance of 2e-6.
AGREEING_SLOTS = 31

#: A crowded region has at most LEADERS leaders, chosen among the LEADER_SAMPLE members with the smallest hashes; no two of
#: them agree in LEADER_SLOTS slots. Leaders do not limit what is compared within regions, they only add links.
LEADERS = 8
LEADER_SAMPLE = 64
LEADER_SLOTS = 52
#: Members that are set beside a copy of their leader in one group.
LEADER_ROWS = 256
#: Shingles in a block of texts; at most two blocks, or two texts if they are longer, are compared in one group.
BLOCK_SHINGLES = 1_000_000

_STEP = SLOTS // ORDERS
_FACTORS = np.random.default_rng(20240301).integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray) -> bytes:
    """SLOTS minima of the set under as many hash functions, four bytes each, big-endian."""
    mixed = found ^ (found >> np.uint64(32))
    least = np.full(SLOTS, np.uint64(2**64 - 1))
    for start in range(0, len(mixed), 2048):
        least = np.minimum(least, (mixed[start : start + 2048, None] * _FACTORS).min(0))
    return (least >> np.uint64(32)).astype(">u4").tobytes()


_FEATURES = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])


@F.pandas_udf(_FEATURES)
def _features(texts: pd.Series) -> pd.DataFrame:
    take_turn("near_dedup")
    rows = []
    for text in texts:
        found = shingles(text)
        rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found)) if len(found) else (0, None, None))
    return pd.DataFrame(rows, columns=["n_shingles", "digest", "signature"])


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in batches that are sorted by key; a run may span batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if rest and rest[0][key].iloc[0] != keys[0]:
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        edges = [0, *cuts.tolist(), len(batch)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            part = batch.iloc[start:end]
            if end == len(batch):
                rest.append(part)
            elif rest:
                yield pd.concat([*rest, part])
                rest = []
            else:
                yield part
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _blocks(region: int, ids: list[int], n: np.ndarray, partners: dict[int, list[int]]) -> list[tuple[int, int, list[int]]]:
    """(group, id, ids of its partners): members with candidates stand in blocks by the length of their texts, in their order;
    each pair of blocks that holds candidates is a group."""
    members = sorted(partners)
    block = dict(zip(members, ((np.cumsum(n[members]) - n[members]) // BLOCK_SHINGLES).tolist(), strict=True))
    groups: dict[tuple[int, int], dict[int, list[int]]] = {}
    for i, js in partners.items():
        for j in js:
            group = groups.setdefault((block[i], block[j]), {})
            group.setdefault(i, []).append(ids[j])
            group.setdefault(j, [])
    out = []
    for pair, group in groups.items():
        key = int(np.frombuffer(xxhash.xxh64_digest(np.array([region, *pair], np.int64).tobytes()), np.int64)[0])
        out += [(key, ids[i], found) for i, found in group.items()]
    return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each region, its members that have candidates, each with those that follow it in the region."""
    out: list[tuple] = []
    for region in _groups(batches, "region"):
        if len(region) < 2:
            continue
        ids, order = region["rep"].to_numpy(), int(region["place"].iloc[0])
        n = region["n_shingles"].to_numpy()
        slots = np.frombuffer(b"".join(region["signature"]), ">u4").astype(np.uint32).reshape(-1, SLOTS)
        regions = np.stack(region["regions"].to_numpy())[:, : order + 1]
        partners: dict[int, list[int]] = {}
        for i in range(len(ids) - 1):
            fits = ((slots[i + 1 :] == slots[i]).sum(1) >= AGREEING_SLOTS) & (100 * np.minimum(n[i + 1 :], n[i]) >= SIMILARITY_PERCENT * np.maximum(n[i + 1 :], n[i]))
            fitting = np.flatnonzero(fits) + i + 1
            first = ((regions[fitting] == regions[i]) & (regions[i] != 0)).argmax(1)
            for j in fitting[first == order].tolist():
                partners.setdefault(i, []).append(j)
                partners.setdefault(j, [])
        out += _blocks(int(region["region"].iloc[0]), ids.tolist(), n, partners)
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=["region", "rep", "partners"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["region", "rep", "partners"])


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each region, a star (smallest id, member) for every group that links on full sets hold together."""
    out: list[tuple[int, int]] = []
    for region in _groups(batches, "region"):
        ids = region["rep"].to_numpy()
        sets = [shingles(t) for t in region["text"]]
        n = np.array([len(s) for s in sets])
        rows_of: dict[int, list[int]] = {}
        for i, doc in enumerate(ids.tolist()):
            rows_of.setdefault(doc, []).append(i)
        root = {doc: doc for doc in rows_of}

        def find(x: int) -> int:
            while root[x] != x:  # noqa: B023
                root[x] = root[root[x]]  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for i, partners in enumerate(region["partners"]):
            own = find(int(ids[i]))
            others = [j for p in partners.tolist() if find(p) != own for j in rows_of[p]]
            for start in range(0, len(others), 256):
                block = [j for j in others[start : start + 256] if n[j]]
                if not block or not n[i]:
                    continue
                joined = np.concatenate([sets[j] for j in block])
                at = np.minimum(np.searchsorted(sets[i], joined), n[i] - 1)
                shared = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(n[block])[:-1]]))
                for j in np.array(block)[100 * shared >= SIMILARITY_PERCENT * (n[i] + n[block] - shared)].tolist():
                    x, y = find(int(ids[i])), find(int(ids[j]))
                    root[max(x, y)] = min(x, y)
        out += [(find(doc), doc) for doc in root if find(doc) != doc]
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["a", "b"])


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many slots two signatures agree."""
    slots = [np.frombuffer(b"".join(x), ">u4").reshape(-1, SLOTS) for x in (a, b)]
    return pd.Series((slots[0] == slots[1]).sum(1).astype(np.int32))


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The leaders of each region among its sampled members, which are sorted by hash."""
    for region in _groups(batches, "region"):
        slots = np.frombuffer(b"".join(region["signature"]), ">u4").reshape(-1, SLOTS)
        chosen: list[int] = []
        for i in range(len(slots)):
            if len(chosen) < LEADERS and (slots[chosen] == slots[i]).sum(1).max(initial=0) < LEADER_SLOTS:
                chosen.append(i)
        yield region.iloc[chosen][["region", "size", "rep", "n_shingles", "signature"]]


def _ties(crowd: DataFrame) -> DataFrame:
    """(leader, rep, n_shingles, size): the members of crowded regions that may link with a leader of their region. Each region and its
    leaders are dealt into as many parts as its size asks for.

    crowd: rep, region, size, signature, n_shingles.
    """
    parts = F.ceil(F.col("size") / (2 * LEADER_ROWS)).cast("long")
    order = F.row_number().over(Window.partitionBy("region").orderBy("h", "rep"))
    sample = crowd.withColumn("h", F.xxhash64("rep", F.lit(5))).withColumn("k", order).filter(F.col("k") <= LEADER_SAMPLE)
    sample = sample.select("region", "k", "size", "rep", "n_shingles", "signature").repartition("region").sortWithinPartitions("region", "k")
    leaders = sample.mapInPandas(_leaders, "region long, size long, rep long, n_shingles long, signature binary").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    leaders = leaders.select("region", "part", F.col("rep").alias("leader"), F.col("n_shingles").alias("leader_n"), F.col("signature").alias("leader_signature"))
    beside = crowd.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(6)), parts)).join(leaders.hint("merge"), ["region", "part"]).filter(F.col("rep") != F.col("leader"))
    near = 100 * F.least("n_shingles", "leader_n") >= SIMILARITY_PERCENT * F.greatest("n_shingles", "leader_n")
    return beside.filter(near).filter(_agreeing("signature", "leader_signature") >= AGREEING_SLOTS).select("leader", "rep", "n_shingles", "size")


def _tied(ties: DataFrame) -> DataFrame:
    """Candidates as _candidates gives them: each leader with its members, in groups of bounded size. Members are parted by
    the power of two that bounds their length, so that long ones go in smaller groups."""
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_shingles"))))
    parts = F.ceil(F.col("size") * F.greatest(F.lit(1 / LEADER_ROWS), bound / BLOCK_SHINGLES)).cast("long")
    pairs = ties.groupBy("leader", "rep").agg(F.max("size").alias("size"), F.max("n_shingles").alias("n_shingles"))
    dealt = pairs.select("leader", "rep", F.xxhash64("leader", F.lit("ties"), bound, parts, F.pmod(F.xxhash64("rep", F.lit(9)), parts)).alias("region"))
    own = dealt.groupBy("region", "leader").agg(F.collect_list("rep").alias("partners"))
    return own.select("region", F.col("leader").alias("rep"), "partners").unionByName(dealt.select("region", "rep", F.array().cast("array<long>").alias("partners")))


def _regions(reps: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rep, place, region, whole): the region of each class representative in each order; those alone in a place are left
    out. ``whole`` is another region only where runs are cut (see _in_runs); it is one for each rep and place.

    Only sizes are counted per place (a partial count before the shuffle); crowded places go to the next depth. Second come
    the ties of crowded regions at each depth (see _ties), third the representatives (rep) that stand in a crowded region at
    the first depth; both None where no place is crowded.
    """
    twice = F.concat("signature", "signature")
    active = reps.select("rep", "signature", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("place"))
    found: DataFrame | None = None
    ties: DataFrame | None = None
    crowd: DataFrame | None = None
    for depth in DEPTHS:
        prefix = F.substring(twice, F.col("place") * (4 * _STEP) + 1, F.lit(4 * depth))
        keyed = active.select("rep", "place", F.xxhash64("place", F.lit(depth), prefix).alias("region"))
        sizes = keyed.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
        # always a merge join, so that what is shuffled grows evenly; signatures stay behind
        sized = stored(keyed.join(sizes.hint("merge"), "region"), "regions")
        crowded = F.col("size") > REGION_ROWS
        # stored, so that Spark knows how small it is and neither signatures nor texts are shuffled to be joined with it
        parted = stored(sized.filter(crowded), "crowded")
        settled = parted.isEmpty()
        last = depth == DEPTHS[-1] or settled
        if not settled:
            crowd = stored(parted.select("rep").distinct(), "crowd") if crowd is None else crowd
            tied = stored(_ties(parted.join(reps, "rep")), "ties")
            ties = tied if ties is None else ties.unionByName(tied)
        here = (sized if last else sized.filter(~crowded)).select("rep", "place", "region")
        found = here if found is None else found.unionByName(here)
        if last:
            break
        active = parted.select("rep", "place").join(reps.select("rep", "signature"), "rep")
    return (_in_runs(found) if depth == DEPTHS[-1] else found.withColumn("whole", F.col("region"))), ties, crowd


def _in_runs(found: DataFrame) -> DataFrame:
    """Cuts regions that are crowded at full depth (all minima agree, so any two are most likely links) into runs by hash of the id.
    The smallest member of such a region joins each of its runs and so ties them together: it has a row for each run.
    ``whole`` is the region before the cut."""
    sizes = found.groupBy("region").agg(F.count("*").alias("size"), F.min("rep").alias("least"))
    counted = found.join(sizes, "region").withColumn("runs", F.ceil(F.col("size") / REGION_ROWS).cast("int"))
    every = F.sequence(F.lit(0).cast("long"), F.col("runs").cast("long") - 1)
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("runs")))
    dealt = counted.withColumn("r", F.explode(F.when(F.col("rep") == F.col("least"), every).otherwise(own)))
    return dealt.select("rep", "place", F.when(F.col("runs") <= 1, F.col("region")).otherwise(F.xxhash64("region", "r")).alias("region"), F.col("region").alias("whole"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) with ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked where 100 * shared shingles >= 75 * all shingles of both. The component is the smallest doc_id
    that links reach. Null or wordless texts have no shingle and stand alone. Rows that share a doc_id count as one
    document with several texts; a row that repeats a kept id is not kept a second time. A row with a null doc_id is
    linked with nothing: its component is null and it is kept. An empty table gives an empty result. Columns named as a
    result column are replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    found = components(docs).filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = docs.join(found, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))) == 1
    return out.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0))).withColumn("kept", F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("component_id")) & first))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``; see near_duplicates."""
    features = stored(docs.select("doc_id", _features("text").alias("f")).select("doc_id", "f.n_shingles", "f.digest", "f.signature"), "near-features")
    classes = stored(features.filter("digest is not null and doc_id is not null").groupBy("digest", "signature", "n_shingles").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = classes.select("rep", "signature", "n_shingles")
    found, ties, crowd = _regions(reps)
    per_rep = found.groupBy("rep").agg(*[F.max(F.when(F.col("place") == i, F.col("whole"))).alias(f"r{i}") for i in range(ORDERS)])
    per_rep = per_rep.select("rep", F.array(*[F.coalesce(f"r{i}", F.lit(0).cast("long")) for i in range(ORDERS)]).alias("regions"))
    per_rep = reps.join(per_rep.hint("merge"), "rep").select("rep", "signature", "n_shingles", "regions")
    members = per_rep.join(found.select("rep", "place", "region").hint("merge"), "rep")
    dealt = members.repartition("region").sortWithinPartitions("region", "rep")
    candidates = dealt.mapInPandas(_candidates, "region long, rep long, partners array<long>")
    candidates = stored(candidates if ties is None else candidates.unionByName(_tied(ties)), "near-candidates")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").filter("text is not null")
    beside = texts.join(candidates.hint("merge"), "rep").select("region", "rep", "partners", "text").repartition("region").sortWithinPartitions("region", "rep")
    stars = beside.mapInPandas(_confirmed, "a long, b long")
    if crowd is not None:
        # what crowded regions may have parted: the exact join of their members, as far as they aren't linked yet
        stars = stored(stars, "near-stars")
        texts_of = docs.join(crowd.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        stars = stars.unionByName(jaccard_join.remaining_links(jaccard_join.sets_that_may_link(texts_of, SIMILARITY_PERCENT)[1], stars, SIMILARITY_PERCENT))
    linked = connected_components(stars, "a", "b")
    named = classes.join(linked.hint("merge"), F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = features.select("doc_id", "n_shingles", "digest").join(named.hint("merge"), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS shingle
      FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, l.b), d.doc_id) AS component_id, d.doc_id = coalesce(least(d.doc_id, l.b), d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""
