"""Benchmark decontamination with spaced seeds; DataFrame functions only.

A seed is the hash of the tokens at the positions that a fixed mask selects; the positions between may differ. The seeds
of all places of all documents are joined with those of the benchmark items. A hit fixes an alignment (item, offset in the
document), and the tokens along it are compared one by one. A document is contaminated where some 13 tokens of an item agree
with it in 11 at least; of an item of seven to twelve tokens all but one must agree, of a shorter one all. Each mask serves
items of some lengths, such that every set of differences that is let pass leaves a seed of one of them: none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW = 13
AGREEING = 11
#: Places that each mask selects, and the fewest and most tokens of the items that it is for. Every choice of two differing
#: places among 13, or of one among ten to twelve, leaves a seed of the first or second; one among seven to nine leaves three
#: tokens in a row. A mask is laid over the documents only if the benchmark has items of its lengths.
MASKS = (((0, 1, 2, 4, 7, 8), 10, None), ((0, 1, 2, 4, 5, 6), 10, None), ((0, 1, 2), 3, 9), ((0, 1), 2, 2), ((0,), 1, 1))
#: A side is broadcast up to so many rows (at most about 64 bytes each).
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(text: Column, masks: list[int]) -> Column:
    """An array for each of these masks of the seeds at each place, in order of place."""

    def of(hashes: Column) -> Column:
        def one(number: int) -> Column:
            places = MASKS[number][0]
            last = F.size(hashes) - 1 - max(places)
            seed = lambda i: F.xxhash64(F.lit(number), *[F.get(hashes, i + o) for o in places])
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(F.array().cast("array<bigint>"))

        return F.array(*[one(number) for number in masks])

    return F.get(F.transform(F.array(_hashes(text)), of), F.lit(0))  # the hashes are bound once, not once a place


def _serves(number: int, size: Column) -> Column:
    """If a mask is for items of so many tokens."""
    _, least, most = MASKS[number]
    return (size >= least) & (size <= most) if most else size >= least


def needed(size: Column) -> Column:
    """How many tokens of a window of an item with so many tokens must agree."""
    return F.when(size >= WINDOW, F.lit(AGREEING)).otherwise(size - F.floor(size * (WINDOW - AGREEING) / WINDOW))


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; without one Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift): where a seed of an item meets a document; shift is the item's start in it."""
    sound = lambda df, id: df.filter(F.col(id).isNotNull() & F.col("text").isNotNull())
    items = sound(benchmark, "item_id").select("item_id", "text", F.size(tokens(F.col("text"))).alias("n"))
    used = items.agg(*[F.coalesce(F.bool_or(_serves(k, F.col("n"))), F.lit(False)).alias(f"m{k}") for k in range(len(MASKS))]).first()
    masks = [k for k in range(len(MASKS)) if used[f"m{k}"]]
    if not masks:
        return sound(docs, "doc_id").select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("shift")).filter(F.lit(False))
    serving = F.array(*[_serves(k, F.col("n")) for k in masks])
    seeds = lambda df, *kept: df.select(*kept, F.posexplode(_seeds(F.col("text"), masks)).alias("mask", "seeds"))
    theirs = seeds(items, "item_id", "n").filter(F.get(serving, F.col("mask")))
    theirs = stored(theirs.select("item_id", F.posexplode("seeds").alias("item_place", "seed")).distinct(), "benchmark-seeds")
    ours = seeds(sound(docs, "doc_id"), "doc_id").select("doc_id", F.posexplode("seeds").alias("place", "seed"))
    hits = ours.join(_small(theirs), "seed")
    return hits.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.count("*").alias("seeds")).drop("seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, best_matches, first_token) for each document that holds a passage of a benchmark item.

    ``best_matches`` is the largest number of agreeing tokens in a window of 13 that starts with an agreeing one;
    ``first_token`` is the place in the document of the first window with enough of them. Items of seven to twelve tokens need
    all tokens but one, shorter ones all. Null texts and ids, and items without tokens, match nothing; texts of any length
    are read whole. Repeated rows give one result. Empty tables give an empty result. Further columns, also ones named like
    a result column, are ignored.
    """
    found = stored(alignments(docs, benchmark), "alignments")
    ids = _small(stored(found.select("doc_id").distinct(), "aligned"))
    read = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("doc_id", _hashes(F.col("text")).alias("ours"))
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("theirs"))
    both = found.join(read, "doc_id").join(items, "item_id")
    start, end = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("theirs"), F.size("ours") - F.col("shift"))
    agreeing = F.transform(F.sequence(start, end - 1), lambda i: F.when(F.get("theirs", i) == F.get("ours", i + F.col("shift")), i))
    placed = both.filter(end > start).select("doc_id", "item_id", "shift", F.size("theirs").alias("n"), F.array_compact(agreeing).alias("at"))
    near = F.transform("at", lambda i: F.struct(F.size(F.filter("at", lambda j: (j >= i) & (j < i + WINDOW))).alias("matches"), i.alias("place")))
    windows = placed.select("doc_id", "item_id", "shift", F.explode(F.filter(near, lambda w: w["matches"] >= needed(F.col("n")))).alias("w"))
    return windows.groupBy("doc_id", "item_id").agg(F.max("w.matches").cast("long").alias("best_matches"), F.min(F.col("w.place") + F.col("shift")).cast("long").alias("first_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; rows with a null id stay."""
    return docs.join(stored(contaminated(docs, benchmark).select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words),
listed AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS q FROM listed),
m AS (SELECT DISTINCT doc_id, item_id, n, p - q AS shift, q FROM d JOIN b USING (word)),
busy AS (SELECT doc_id, item_id, shift FROM m GROUP BY doc_id, item_id, n, shift HAVING count(*) >= CASE WHEN n >= 13 THEN 11 ELSE n - floor(n * 2 / 13) END),
c AS (SELECT doc_id, item_id, n, shift, q, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS matches
      FROM m JOIN busy USING (doc_id, item_id, shift))
SELECT doc_id, item_id, max(matches) AS best_matches, min(q + shift) AS first_token
FROM c WHERE matches >= CASE WHEN n >= 13 THEN 11 ELSE n - floor(n * 2 / 13) END GROUP BY doc_id, item_id
"""
