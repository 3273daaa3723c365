"""Lexical index and search, vectors, fusion, reranking (E1-E11)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recovery import let_go, written
from ..functions.terms import terms
from ..sources.keyed import BUCKETS, KeyedTables
from . import segments
from .text import chunk

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
PREFIX_CAP = 1000
BLOCK_QUERIES = 2000
BLOCK_VECTORS = 20_000
#: Vectors for which there is a pivot, and the most pivots, which each worker holds.
CELL_VECTORS = 5000
MOST_PIVOTS = 4096
ANGLE_SLACK = 1e-5


#: Postings of a segment that are scored first, for a score that the k-th best reaches at least.
SEED_POSTINGS = 2000

TERMS = "terms array<struct<term:string,tf:int>>"
PASSAGES = f"target_version string, passage_id string, ord int, char_start int, char_end int, text string, section int, section_text string, length long, {TERMS}"


@dataclass
class LexicalIndex:
    """rows (passage_id, target_version, length, terms with their frequency), where length is the passage's number of terms;
    postings (term, passage_id, target_version, length, tf), which are the same one by one; frequencies (term, df), and totals (one
    row: passages, average)."""

    rows: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, rows: DataFrame) -> LexicalIndex:
        postings = rows.select("passage_id", "target_version", "length", F.inline("terms")).withColumn("tf", F.col("tf").cast("long"))
        return cls(rows, postings, postings.groupBy("term").agg(F.count("*").alias("df")), rows.agg(F.count("*").alias("passages"), F.avg("length").alias("average")))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with ``terms``, an array of terms with repeats that comes last, as an array of different terms with their frequency."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy())
            many = max(1, len(words.dictionary))
            found, tf = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
            terms_ = pa.StructArray.from_arrays([words.dictionary.take(pa.array(found % many)), pa.array(tf, pa.int32())], ["term", "tf"])
            edges = pa.array(np.searchsorted(found // many, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(edges, terms_)], batch.schema.names)
        let_go()

    return rows.mapInArrow(run, f"{kinds}, {TERMS}")


def index_rows(passages: DataFrame) -> dict[str, DataFrame]:
    """Passages as an index folder holds them: with their number of terms, ``length``, and their ``terms``, counted where they lie."""
    found = terms(F.col("text"))
    return {"passages": _counted(passages.select("*", F.size(found).cast("long").alias("length"), found.alias("terms")))}


def index_bodies(bodies: DataFrame) -> dict[str, DataFrame]:
    """The rows of an index folder for bodies (target_version, body), cut and counted where they lie."""
    return index_rows(chunk(bodies, parents="first"))


def index_folder(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedTables:
    """A lexical index on disk, whose rows are replaced by target_version."""
    return KeyedTables(spark, folder, {"passages": PASSAGES}, "target_version", buckets)


def open_index(tables: KeyedTables) -> tuple[DataFrame, LexicalIndex]:
    """(passages, index) of an index folder as it is now. A section stands once among the passages, see ``chunk``."""
    rows = tables.read("passages")
    return rows.drop("terms"), LexicalIndex.of(rows.select("passage_id", "target_version", "length", "terms"))


def build_index(passages: DataFrame) -> LexicalIndex:
    """The index of (passage_id, target_version, text), in a table for this one use."""
    return LexicalIndex.of(written(index_rows(passages.select("passage_id", "target_version", "text"))["passages"].drop("text"), "index-rows"))


def query_terms(queries: DataFrame, mode: str = "any") -> DataFrame:
    """(query_id, term, times, mode): the terms of each query; a query without terms has no row. Modes: any (whole terms, any
    of them), prefix (terms begin index terms, any of them), all (each run between white space is a phrase of terms, all of
    them; ``term`` is the phrase, its terms parted by a space)."""
    if mode not in ("any", "prefix", "all"):
        raise ValueError(f"no such mode: {mode}")
    found = F.transform(F.split("question", r"(?U)\s+"), lambda run: F.array_join(terms(run), " ")) if mode == "all" else terms(F.col("question"))
    rows = queries.select("query_id", F.explode(F.filter(found, lambda x: x != "")).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("mode", F.lit(mode))


def starts_of(asked: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(query_id, start, term, times): the index terms that each asked term begins. A term has a start of each asked length up
    to its own: an equality join on the length, then one on the start."""
    lengths = asked.select(F.length("term").alias("n")).distinct()
    longest = lengths.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    keyed = frequencies.select("term", F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest)))).alias("n")).join(lengths, "n")
    keyed = keyed.select(F.substring(F.col("term"), F.lit(1), F.col("n")).alias("start"), "term")
    return asked.select("query_id", F.col("term").alias("start"), "times").join(keyed, "start")


def phrase_passages(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage_id): the passages with every phrase of a query (mode all). A passage must first have all terms of
    the query; only then are its phrases looked for, side by side in its sequence of terms."""
    phrases = query_terms(queries, "all").select("query_id", "term")
    parts = phrases.select("query_id", F.explode(F.split("term", " ")).alias("term")).distinct()
    needed = parts.groupBy("query_id").agg(F.count("*").alias("needed"))
    held = passages.select("passage_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    whole = held.join(parts, "term").groupBy("query_id", "passage_id").agg(F.count("*").alias("n")).join(needed, "query_id").filter("n = needed").select("query_id", "passage_id")
    lines = passages.select("passage_id", F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" ")).alias("line"))
    seen = whole.join(lines, "passage_id").join(phrases, "query_id").groupBy("query_id", "passage_id").agg(F.bool_and(F.contains("line", F.concat(F.lit(" "), F.col("term"), F.lit(" ")))).alias("fits"))
    return seen.filter("fits").select("query_id", "passage_id")


def term_frequencies(queries: DataFrame, index: LexicalIndex, mode: str = "any") -> DataFrame:
    """(query_id, term, times, mode, df): df is null for terms that aren't in the index. In mode prefix it is the number of
    index terms that begin so; mode all is of phrases, which phrase_passages finds."""
    asked = query_terms(queries, mode)
    if mode == "prefix":
        found = starts_of(asked, index.frequencies).groupBy("query_id", F.col("start").alias("term")).agg(F.count("*").alias("df"))
        return asked.join(found, ["query_id", "term"], "left").select("query_id", "term", "times", "mode", "df")
    return asked.join(index.frequencies, "term", "left").select("query_id", "term", "times", "mode", "df")


def _part(times: Column, idf: Column) -> Column:
    """What a term adds to a passage's score, which is negative."""
    return times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))


def _weighed(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, term, times, average, df, idf, bound): the asked terms that the index has; bound is the most that one adds to
    a passage's score. Only the postings of asked terms are read for it."""
    wanted = asked.select("term").distinct()
    one = (F.lit(1.0), F.lit(1.0))
    held = index.postings.join(wanted, "term", "left_semi").crossJoin(F.broadcast(index.totals))  # totals: one row
    stats = held.groupBy("term").agg(F.count("*").alias("df"), F.max(_part(*one)).alias("most"), F.first("passages").alias("passages"), F.first("average").alias("average"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("passages") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rows = asked.join(stats, "term").withColumn("idf", idf)
    return rows.select("query_id", "term", "times", "average", "df", "idf", (F.col("times") * F.col("idf") * F.col("most")).alias("bound"))


def _scored(weighed: DataFrame, index: LexicalIndex, live: DataFrame | None) -> DataFrame:
    hits = index.postings.join(weighed.select("query_id", "term", "times", "average", "idf"), "term")
    hits = hits if live is None else hits.join(live, "target_version", "left_semi")
    return hits.groupBy("query_id", "passage_id", "target_version").agg((-F.sum(_part(F.col("times"), F.col("idf")))).alias("score"), F.count("*").alias("matched"))


def bm25(asked: DataFrame, index: LexicalIndex, live: DataFrame | None = None) -> DataFrame:
    """(query_id, passage_id, target_version, score, matched): scores of all passages with a term of the query, negative
    is better. ``live`` restricts what is returned, not the statistics. Only the postings of asked terms are read."""
    return _scored(_weighed(asked, index), index, live)


def top(rows: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query in an order, with ``rank`` from 1; Spark cuts each partition before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def _only(index: LexicalIndex, live: DataFrame | Column | None) -> DataFrame:
    """The index's rows of live targets: a table of target_versions or a condition on target_version, by which no passage moves."""
    return index.rows if live is None else index.rows.filter(live) if isinstance(live, Column) else index.rows.join(live.select("target_version"), "target_version", "left_semi")


def lexical_search(queries: DataFrame, index: LexicalIndex, k: int, live: DataFrame | Column | None = None) -> DataFrame:
    """(query_id, passage_id, target_version, score, rank), stored: the k best passages of each query by BM25, exact. ``live`` restricts what
    is returned, not the statistics: a table of target_versions, or a condition on target_version.

    Frequencies are counted for all terms before they meet the asked ones, and passages are scored where they lie, so no posting
    is shuffled.
    """
    asked = written(query_terms(queries), "asked-terms")  # small for short questions, and then of a size that Spark knows
    passages, average = index.totals.first()
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(passages) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weights = written(asked.join(index.frequencies, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")), "weights")
    return segments.best(weights, _only(index, live), k, average or 1.0, K1, B, SEED_POSTINGS)


def prefix_search(queries: DataFrame, index: LexicalIndex, notes: DataFrame, cap: int = PREFIX_CAP, live: Column | None = None) -> DataFrame:
    """(query_id, note_id, score, rank): quick search where each query term stands for all index terms that it begins. The
    first ``cap`` passages of a query count; a note has the rank of its best one. notes: note_id, head_version_id. ``live`` may
    say as a condition on target_version which of them are heads."""
    asked = written(query_terms(queries, "prefix").select("query_id", "term", F.col("times").cast("double").alias("weight")), "asked-terms")
    heads = notes.select("note_id", F.col("head_version_id").alias("target_version"))
    passages, average = index.totals.first()
    prefixes = segments.Prefixes(index.frequencies, passages, LEAST_IDF)
    best = segments.best(asked, _only(index, heads if live is None else live), cap, average or 1.0, K1, B, SEED_POSTINGS, prefixes).join(heads, "target_version")
    per_note = best.groupBy("query_id", "note_id").agg(F.min("rank").alias("best"), F.min_by("score", "rank").alias("score"))
    return per_note.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best")).cast("long")).drop("best")


SNIPPET_CHARS = 240


def preview(text: Column, size: int = SNIPPET_CHARS) -> Column:
    """A text on one line, white space as single spaces; a longer one is cut at ``size`` and marked with three dots."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("...")))


def search_all_or_any(queries: DataFrame, index: LexicalIndex, limit: int = 5, classes: DataFrame | None = None, passages: DataFrame | None = None) -> DataFrame:
    """(query_id, passage_id, target_version, score, fallback, rank): passages with all terms of a query; for queries
    without one, passages with any.

    With ``classes`` (target_version, class), a query whose own ``class`` isn't null finds passages of that class alone, also
    for the choice between all and any. With ``passages``, hits carry a ``snippet``, the beginning of their text on one line.
    """
    asked = query_terms(queries)
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    scored = bm25(asked, index).join(needed, "query_id")
    if classes is not None:
        wanted = queries.select("query_id", F.col("class").alias("wanted"))
        scored = scored.join(wanted, "query_id").join(classes, "target_version", "left").filter(F.col("wanted").isNull() | (F.col("class") == F.col("wanted"))).drop("wanted", "class")
    scored = written(scored, "class-scores")  # read twice
    whole = scored.groupBy("query_id").agg(F.max((F.col("matched") == F.col("needed")).cast("int")).alias("any_whole"))
    kept = scored.join(whole, "query_id").filter((F.col("any_whole") == 0) | (F.col("matched") == F.col("needed"))).withColumn("fallback", F.col("any_whole") == 0)
    hits = top(kept, limit, F.round("score", 9), F.col("passage_id")).select("query_id", "passage_id", "target_version", "score", "fallback", "rank")
    return hits if passages is None else hits.join(passages.select("passage_id", preview(F.col("text")).alias("snippet")), "passage_id")


def hashed_words(texts: list[str], width: int = 64) -> np.ndarray:
    """The default embedder: unit vectors of hashed word counts."""
    out = np.zeros((len(texts), width), np.float32)
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            out[i, h % width] += 1 if h >> 63 else -1
    sizes = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(sizes == 0, 1, sizes)


def embed(passages: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_words, model: str = "hashed", revision: str | None = None, prefix: str = "") -> DataFrame:
    """(passage_id, target_version, vector, model, model_revision) by a pluggable embedder, a batch of texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"passage_id": batch["passage_id"], "target_version": batch["target_version"], "vector": list(embedder([prefix + (t or "") for t in batch["text"]]))})

    rows = passages.select("passage_id", "target_version", "text").mapInPandas(run, "passage_id string, target_version string, vector array<float>")
    return rows.withColumns({"model": F.lit(model), "model_revision": F.lit(revision).cast("string")})


def revision_audit(vectors: DataFrame, model: str, current: str | None) -> DataFrame:
    """(model, vectors, revisions, mixed, drift): a null revision counts as one; drift is a known revision other than the
    current one, of the current model."""
    other = (F.col("model") == model) & F.col("model_revision").isNotNull() & (F.col("model_revision") != F.lit(current))
    rows = vectors.groupBy("model").agg(F.count("*").alias("vectors"), F.count_distinct(F.coalesce("model_revision", F.lit("\0"))).alias("revisions"), F.coalesce(F.bool_or(other), F.lit(False)).alias("drift"))
    return rows.select("model", "vectors", "revisions", (F.col("revisions") > 1).alias("mixed"), "drift")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@dataclass
class _Cells:
    """Pivots (unit vectors, by their number of components), and for each cell the angles between which its vectors lie from
    its pivot, how many there are and into how many blocks they are dealt. At most MOST_PIVOTS cells of each width, and one for vectors
    of a width that no pivot has."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int]
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray
    blocks: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, least angles): how near to a unit vector the vectors of each cell can be at least. The angle between unit
        vectors is a distance, so the triangle inequality holds for it."""
        width = len(q)
        if width not in self.pivots:
            return np.array([len(self.size) - 1]), np.zeros(1)
        cells = self.first[width] + np.arange(len(self.pivots[width]))
        own = np.arccos(np.clip(self.pivots[width] @ q, -1, 1))
        return cells, np.maximum(0, np.maximum(own - self.far[cells], self.near[cells] - own))


def _unit(vectors: pd.Series) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, empty and zero vectors and those with components that aren't finite."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None else np.asarray(v, np.float64)
        size = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.linalg.norm(x))
        out.append(x / size if size > 0 else None)
    return out


def _nearest(wanted: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a block's vectors for each of its queries, and what a rounded distance may tie with."""
    out = [pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "passage_id", "target_version", "distance")})]
    vectors = _unit(held["held"])
    for width, some in wanted.groupby(wanted["asked"].map(len)) if len(wanted) and len(held) else ():
        mine = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
        if not mine:
            continue
        near, x = held.iloc[mine], np.stack([vectors[i] for i in mine])
        names, targets = near["passage_id"].to_numpy(), near["target_version"].to_numpy()
        for query, one in zip(some["query_id"], _unit(some["asked"]), strict=True):
            row = 1 - x @ one
            edge = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            best = np.flatnonzero(row <= edge + 1e-9)
            out.append(pd.DataFrame({"query_id": query, "passage_id": names[best], "target_version": targets[best], "distance": row[best]}))
    return pd.concat(out[1:]) if len(out) > 1 else out[0]


def _cells(rows: DataFrame, cell_vectors: int) -> tuple[_Cells, DataFrame]:
    """The cells of some vectors, and the vectors (stored) with the number of their cell, whose pivot is the nearest."""
    n = min(MOST_PIVOTS, max(1, -(-rows.count() // cell_vectors)))
    sample = [x for x in _unit(pd.Series([r[0] for r in rows.orderBy(F.xxhash64("passage_id", F.lit(8)), "passage_id").select("held").limit(n).collect()])) if x is not None]
    widths = sorted({len(x) for x in sample})
    pivots = {w: np.stack([x for x in sample if len(x) == w]) for w in widths}
    first = dict(zip(widths, np.cumsum([0, *(len(pivots[w]) for w in widths)]).tolist(), strict=False))
    other = sum(map(len, pivots.values()))

    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def place(vectors: pd.Series) -> pd.DataFrame:
        out = []
        for x in _unit(vectors):
            if x is None:
                out.append((None, None))
            elif len(x) not in pivots:
                out.append((other, 0.0))
            else:
                near = pivots[len(x)] @ x
                out.append((first[len(x)] + int(near.argmax()), float(np.arccos(np.clip(near.max(), -1, 1)))))
        return pd.DataFrame(out, columns=["cell", "angle"])

    placed = written(rows.withColumn("_p", place("held")).select("passage_id", "target_version", "held", F.col("_p.cell").alias("cell"), F.col("_p.angle").alias("angle")).filter("cell is not null"), "cells")
    near, far, size = np.zeros(other + 1), np.full(other + 1, np.pi), np.zeros(other + 1, np.int64)
    for cell, count, low, high in placed.groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle")).collect():
        size[cell] = count
        if cell < other:
            near[cell], far[cell] = low - ANGLE_SLACK, high + ANGLE_SLACK
    return _Cells(pivots, first, near, far, size, np.maximum(1, -(-size // BLOCK_VECTORS))), placed


def _visited(asked: DataFrame, placed: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """(query_id, passage_id, target_version, distance): the nearest of the vectors of the cells that each query asks for. asked:
    query_id, asked, cells. A cell's vectors and the queries that ask for it are dealt into blocks; a pair of blocks is a group."""
    spread = asked.select("query_id", "asked", F.explode("cells").alias("cell"))
    parts = spread.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qn"))
    dealt = asked.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(cells.blocks)], "cell int, vn int")  # at most a row for each pivot
    parts = parts.join(F.broadcast(dealt), "cell")
    blocks = F.col("vn")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    q = spread.join(parts, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qn")).cast("int")).withColumn("vb", every(blocks))
    v = placed.join(parts, "cell").withColumn("own_vb", F.pmod(F.xxhash64("passage_id"), blocks).cast("int")).withColumn("own_qb", every(F.col("qn")))
    kinds = dict(asked.dtypes)["query_id"], dict(placed.dtypes)["passage_id"], dict(placed.dtypes)["target_version"]
    left, right = q.select("cell", "qb", "vb", "query_id", "asked"), v.select("cell", "own_qb", "own_vb", "passage_id", "target_version", "held")
    return left.groupBy("cell", "qb", "vb").cogroup(right.groupBy("cell", "own_qb", "own_vb")).applyInPandas(lambda x, y: _nearest(x, y, k), f"query_id {kinds[0]}, passage_id {kinds[1]}, target_version {kinds[2]}, distance double")


def knn_with_counts(queries: DataFrame, vectors: DataFrame, k: int, live: DataFrame | None = None, cell_vectors: int = CELL_VECTORS) -> tuple[DataFrame, DataFrame]:
    """(the result of ``knn``, one row: pairs of a query and a vector that were compared, and all pairs)."""
    rows = vectors if live is None else vectors.join(live, "target_version", "left_semi")
    cells, placed = _cells(rows.select("passage_id", "target_version", F.col("vector").alias("held")).filter("held is not null"), cell_vectors)
    choice = T.ArrayType(T.IntegerType())

    @F.pandas_udf(choice)
    def home(asked: pd.Series) -> pd.Series:
        """The cells that can be nearest, until they hold k vectors."""
        out = []
        for q in _unit(asked):
            if q is None:
                out.append([])
                continue
            found, least = cells.bounds(q)
            found = found[np.argsort(least, kind="stable")]
            out.append(found[: int(np.searchsorted(np.cumsum(cells.size[found]), k)) + 1].tolist())
        return pd.Series(out, dtype=object)

    @F.pandas_udf(choice)
    def others(asked: pd.Series, reach: pd.Series, seen: pd.Series) -> pd.Series:
        """The other cells that may hold a vector within ``reach`` (a distance; null: any)."""
        out = []
        for q, r, had in zip(_unit(asked), reach, seen, strict=True):
            found, least = cells.bounds(q)
            angle = np.pi if r is None or r != r else float(np.arccos(np.clip(1 - r, -1, 1))) + ANGLE_SLACK
            out.append([c for c in found[least <= angle].tolist() if c not in set(had) and cells.size[c]])
        return pd.Series(out, dtype=object)

    asked = written(queries.select("query_id", F.col("vector").alias("asked")).filter("asked is not null").withColumn("cells", home("asked")).filter(F.size("cells") > 0), "asked")
    first = written(top(_visited(asked, placed, cells, k), k, F.round("distance", 9), F.col("passage_id")), "nearest")
    reach = first.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("reach"))
    more = written(asked.join(reach, "query_id", "left").withColumn("cells", others("asked", "reach", "cells")).select("query_id", "asked", "cells"), "asked")
    found = first.drop("rank").unionByName(_visited(more, placed, cells, k))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    compared = asked.select(F.explode("cells").alias("cell")).unionByName(more.select(F.explode("cells").alias("cell"))).join(sizes, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    return top(found, k, F.round("distance", 9), F.col("passage_id")), compared.withColumn("all_pairs", F.lit(asked.count() * int(cells.size.sum())))


def knn(queries: DataFrame, vectors: DataFrame, k: int, live: DataFrame | None = None) -> DataFrame:
    """(query_id, passage_id, target_version, distance, rank): the k nearest vectors of each query by cosine distance, exact.

    Vectors are dealt to the nearest of some pivots. A query first visits the cells that are nearest, which gives a distance that its
    k-th nearest has at most; then only the cells that may hold something as near, by the triangle inequality of angles. Zero
    vectors, those with components that aren't finite, and vectors of another length take no part.
    """
    return knn_with_counts(queries, vectors, k, live)[0]


def fuse(lexical: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, passage_id, target_version, score, rank): reciprocal rank fusion of two ranked lists. Ties: what the
    lexical list has first, in its order, then the vector list's."""
    leg = lambda df, n: df.select("query_id", "passage_id", "target_version", "rank", F.lit(n).alias("leg"))
    each = leg(lexical, 0).unionByName(leg(vector, 1))
    rows = each.groupBy("query_id", "passage_id", "target_version").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first.leg", "first.rank")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).drop("first")


def overlap_scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """The default reranker: the share of the query's words that a text has."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return pd.Series(out)


def rerank(queries: DataFrame, hits: DataFrame, passages: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] = overlap_scores, cut: int = 20, keep: int = 10) -> DataFrame:
    """Scores the first ``cut`` hits of each query again with a pluggable scorer and keeps the best; hits without a passage
    drop out. Ties keep their order."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return scorer(query, text)

    near = hits.filter(F.col("rank") <= cut).select("query_id", "passage_id", "target_version", F.col("rank").alias("before"))
    rows = near.join(passages.select("passage_id", "text"), "passage_id").join(queries.select("query_id", "question"), "query_id")
    scored = rows.withColumn("score", score("question", "text")).drop("question", "text")
    return top(scored, keep, F.desc(F.round("score", 9)), F.col("before")).drop("before")


def expand(hits: DataFrame, passages: DataFrame, parents: bool = False) -> DataFrame:
    """Hits with the text and range of their passages, and with ``parents`` their parent block; hits without a passage drop out.
    Of the sections, which stand once among the passages, only those of hits are read."""
    if not parents:
        return hits.join(passages.select("passage_id", "text", "char_start", "char_end"), "passage_id")
    found = hits.join(passages.select("passage_id", "section", "text", "char_start", "char_end"), "passage_id")
    found = written(found, "expanded")
    wanted = written(found.select("target_version", "section").distinct(), "sections")
    first = passages.filter("ord = section").select("target_version", "section", F.coalesce("section_text", "text").alias("parent_block"))
    blocks = written(first.join(wanted, ["target_version", "section"], "left_semi"), "parent-blocks")
    return found.join(blocks, ["target_version", "section"]).drop("section")
