"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

1. Vectors that take part are grouped by value; of equal vectors the smallest ids go on, as many as a query can use.
2. A forest is fitted on a bounded sample: each node parts its vectors halfway between two of them.
3. All vectors are put into their leaf of each tree. Leaves with many rows are dealt out over several blocks.
4. For each query one priority queue over all trees gives the leaves on the near side of the closest hyperplanes, until
   they hold enough rows. How many are enough is measured on a few queries against brute force.
5. Queries meet the blocks of their leaves; a block gives the query's nearest in it by exact distance in double precision;
   the nearest of all blocks are the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

NEIGHBOURS = 10
TREES = 6
#: The forest is fitted on so many rows at most, those with the smallest hashes of their ids; all rows are indexed.
SAMPLE_ROWS = 20_000
LEAF_ROWS = 512
BLOCK_ROWS = 4096
#: How far the queue is followed is set on so many queries, whose true neighbours are found by brute force, such that
#: this share of those neighbours lies within.
TUNING_QUERIES = 32
AIMED_RECALL = 0.96


@dataclass
class Tree:
    """Nodes as arrays; a child below 0 is leaf number -1 - child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    sizes: np.ndarray
    root: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.offsets[node]
            at[inner] = self.children[node, side.astype(int)]
        return -1 - at


def grow(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children, sizes = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf_rows:
            for _ in range(5):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                way = a - b
                size = np.linalg.norm(way)
                if not size:
                    continue
                way /= size
                at = sample[rows] @ way
                offset = float((a + b) @ way / 2)
                above = at > offset
                share = above.mean()
                if 0.05 < share < 0.95:
                    me = len(normals)
                    normals.append(way)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[me] = [node(rows[~above]), node(rows[above])]
                    return me
        sizes.append(len(rows))
        return -len(sizes)

    root = node(np.arange(len(sample)))
    width = sample.shape[1]
    return Tree(np.array(normals).reshape(-1, width), np.array(offsets), np.array(children, int).reshape(-1, 2), np.array(sizes), root)


def visited(forest: list[Tree], query: np.ndarray, rows: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until the leaves hold ``rows`` rows of the sample.

    A branch is as near as the smallest margin by which the query fell on the other side on the way to it.
    """
    margins = [t.normals @ query - t.offsets for t in forest]
    queue = [(-np.inf, k, t.root) for k, t in enumerate(forest)]
    out, held = [], 0
    while queue and held < rows:
        far, k, node = heapq.heappop(queue)
        while node >= 0:
            margin = float(margins[k][node])
            low, high = forest[k].children[node].tolist()
            near, other = (high, low) if margin > 0 else (low, high)
            heapq.heappush(queue, (max(far, abs(margin)), k, other))
            node = near
        leaf = -1 - node
        out.append((k, leaf))
        held += int(forest[k].sizes[leaf])
    return out


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part: not null, of the commonest length, finite, not zero. Single-precision vectors stay so
    while they are moved; all distances are worked out in double precision."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    sound = vectors.select("vec_id", F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and v is not null")
    sound = sound.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = sound.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return sound.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _tune(forest: list[Tree], rows: DataFrame, queries: DataFrame, k: int) -> float:
    """How many rows of the sample the visited leaves must hold for the aimed recall."""
    few = queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(TUNING_QUERIES).collect()
    if not few:
        return 0.0
    ids, at = np.array([r["vec_id"] for r in few]), np.array([r["v"] for r in few], np.float64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            x, own = _matrix(batch["v"]), batch["vec_id"].to_numpy()
            for i, q in enumerate(at):
                distance = np.sqrt(((x - q) ** 2).sum(1))
                distance[own == ids[i]] = np.inf
                for j in np.argsort(distance, kind="stable")[:k].tolist():
                    best[i].append((distance[j], own[j], x[j]))
                best[i] = sorted(best[i], key=lambda b: b[:2])[:k]
        yield pd.DataFrame([(i, float(d), v.tolist()) for i, b in enumerate(best) for d, _, v in b if np.isfinite(d)], columns=["q", "d", "v"])

    order = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    true = rows.mapInPandas(nearest, "q int, d double, v array<double>").withColumn("r", order).filter(F.col("r") <= k).collect()  # TUNING_QUERIES * k rows
    needed = []
    for i, q in enumerate(at):
        own = [np.array(r["v"]) for r in true if r["q"] == i]
        if not own:
            continue
        leaves = [t.leaves(np.array(own)) for t in forest]
        held, reached = 0.0, np.full(len(own), np.inf)
        for tree, leaf in visited(forest, q, np.inf):
            held += forest[tree].sizes[leaf]
            hit = (leaves[tree] == leaf) & np.isinf(reached)
            reached[hit] = held
            if not np.isinf(reached).any():
                break
        needed += reached.tolist()
    return 1.05 * float(np.quantile(needed, AIMED_RECALL)) if needed else 0.0


def nearest_neighbours(vectors: DataFrame, is_query: F.Column | None = None, k: int = NEIGHBOURS, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by Euclidean distance.

    Queries are the rows where ``is_query`` holds (default: ids divisible by 100); candidates all rows with another id.
    Ties go to the smaller id; rows that repeat an id give it once, at its smallest distance. Vectors that are null, zero,
    of an uncommon length, or hold null or non-finite components take no part, nor do null ids. Fewer candidates give fewer
    rows; an empty table gives an empty result. Further columns are ignored.
    """
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    usable = stored(_usable(vectors), "ann-rows")
    same = Window.partitionBy("v").orderBy("vec_id")  # of equal vectors only k + 1 can be among anyone's k nearest
    rows = stored(usable.distinct().withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).drop("r"), "ann-candidates")
    queries = usable.filter(is_query)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    at = np.array([r["v"] for r in sample], np.float64)
    scale = len(sample) / total
    rng = np.random.default_rng(20240305)
    forest = [grow(at, max(8, int(LEAF_ROWS * scale)), rng) for _ in range(trees)]
    enough = _tune(forest, rows, queries, k)

    def into_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"]) if len(batch) else np.zeros((0, at.shape[1]))
            for number, tree in enumerate(forest):
                yield pd.DataFrame({"tree": number, "leaf": tree.leaves(x), "vec_id": batch["vec_id"], "v": batch["v"]})

    def to_visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, v in zip(batch["vec_id"], batch["v"], strict=True):
                found = visited(forest, np.asarray(v, np.float64), enough)
                yield pd.DataFrame({"tree": [t for t, _ in found], "leaf": [x for _, x in found], "query_id": query, "q": [v] * len(found)})

    kind = dict(rows.dtypes)["v"]
    members = rows.mapInPandas(into_leaves, f"tree int, leaf int, vec_id long, v {kind}")
    sizes = stored(members.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "ann-leaves")  # at most trees * SAMPLE_ROWS / 8 rows
    blocks = members.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = queries.repartition(F.col("vec_id")).mapInPandas(to_visit, f"tree int, leaf int, query_id long, q {kind}").join(F.broadcast(sizes), ["tree", "leaf"])
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def rerank(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if own.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = _matrix(own["v"]), own["vec_id"].to_numpy()
        out = []
        for query, q in zip(wanted["query_id"], wanted["q"], strict=True):
            distance = np.sqrt(((x - np.asarray(q, np.float64)) ** 2).sum(1))
            distance[ids == query] = np.inf
            best = np.lexsort((ids, distance))[:k] if len(ids) > k else np.arange(len(ids))
            out += [(query, ids[j], distance[j]) for j in best.tolist() if np.isfinite(distance[j])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["tree", "leaf", "block"]
    near = blocks.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
