"""Quality classifier by co-training of two views.

A document is good where its quality label says so and it isn't labelled toxic. The content view sees measurements of the
whole text and which of the telling words occur in it; the metadata view sees language, source and recorded length.
Each view is a logistic regression fitted on a bounded labelled sample. Over several rounds both views score all documents,
and each hands the other confident guesses on unlabelled ones as pseudo-labels. At the end both views are calibrated on labelled
rows that neither was fitted on, their calibrated log-odds are added (the prior once), and all documents are scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, take_turn

LABELLED_ROWS = 8000
POOL_ROWS = 8000
ROUNDS = 2
CONFIDENT = 0.95
KEEP_FROM = 0.5
CONTENT_SIZE = 22
#: Telling words: those of at least WORD_ROWS labelled documents whose share of bad ones differs most. Chi-squared is at least
#: WORD_CHI (a chance of 1e-6 for a word, as some 100,000 words are tried), or a small sample's odd words would be learnt.
WORDS, WORD_ROWS, WORD_CHI = 256, 10, 24.0
_SOURCES, _LANGS, _LENGTHS = 48, 12, 20
METADATA_SIZE = _SOURCES + _LANGS + _LENGTHS

_ASCII = np.arange(256)
_CLASSES = np.stack(
    [
        np.isin(_ASCII, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]),
        (_ASCII >= 48) & (_ASCII <= 57),
        (_ASCII >= 65) & (_ASCII <= 90),
        np.isin(_ASCII, [ord(c) for c in " \t\r\n"]),
        np.isin(_ASCII, [ord(c) for c in ".!?"]),
        np.isin(_ASCII, [ord(c) for c in ",;:()'\"-"]),
        _ASCII >= 128,
        _ASCII == ord("|"),
        _ASCII == ord("!"),
    ],
    axis=1,
).astype(np.float64)


def content_features(text: str | None) -> list[float]:
    """Measurements of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = (np.bincount(raw, minlength=256) @ _CLASSES) / max(1, len(raw))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    ended = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("!\n")
    return [
        np.log1p(n), np.log1p(len(raw)), float(lengths.mean()) / 10, float(lengths.std()) / 10, min(1.0, float(lengths.max()) / 100),
        distinct / max(1, n), distinct / max(1.0, n**0.75), sum(map(eq, words, words[1:])) / max(1, n), float(n > 0) and sum(map(eq, words, words[2:])) / n,
        ended / max(1, n), len(set(lines)) / max(1, len(lines)), len(lines) / max(1, n), float(n == 0), *shares.tolist(),
    ]


_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def word_features(text: str | None, places: dict[str, int]) -> list[float]:
    """1 in the place of each telling word that the text has."""
    out = [0.0] * len(places)
    for word in words_of(text) & places.keys():
        out[places[word]] = 1.0
    return out


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """One-hot language, source and length class; a null has a place of its own."""
    out = [0.0] * METADATA_SIZE
    place = lambda value, size: 0 if value is None or value != value else 1 + zlib.crc32(str(value).encode()) % (size - 1)
    out[place(source, _SOURCES)] = 1.0
    out[_SOURCES + place(lang, _LANGS)] = 1.0
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    out[_SOURCES + _LANGS + (1 + min(_LENGTHS - 2, int(np.log2(1 + n_chars))) if known else 0)] = 1.0
    return out


_BOTH = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("content", "metadata")])


def _both(places: dict[str, int]):
    @F.pandas_udf(_BOTH)
    def both(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        take_turn("quality")
        return pd.DataFrame({"content": [content_features(t) + word_features(t, places) for t in text], "metadata": [metadata_features(*x) for x in zip(lang, source, n_chars, strict=True)]})

    return both("text", "lang", "source", "n_chars")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(text: pd.Series) -> pd.Series:
    take_turn("quality")
    return pd.Series([sorted(words_of(t)) for t in text], dtype=object)


@dataclass
class View:
    """A linear model and its calibration: log-odds = slope * (weights . x + bias) + shift."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.shift


@dataclass
class CoTrained:
    content: View
    metadata: View
    prior: float
    words: tuple[str, ...] = ()

    @property
    def places(self) -> dict[str, int]:
        return {word: i for i, word in enumerate(self.words)}


def _columns(docs: DataFrame) -> DataFrame:
    """The columns that are read; those that a table lacks are null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _fit_view(rows: DataFrame, column: str, size: int) -> View:
    if rows.select("y").distinct().count() < 2:
        share = rows.agg(F.avg("y")).first()[0]
        return View(np.zeros(size), 0.0 if share is None else (3.0 if share > 0.5 else -3.0))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.001, maxIter=60).fit(rows.select(array_to_vector(column).alias("x"), F.col("y").cast("double").alias("y"), "w"))
    return View(np.array(model.coefficients.toArray()), float(model.intercept))


def _logit(view: View, column: str) -> F.Column:
    dot = F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, map(float, view.weights))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.lit(view.slope) * (dot + F.lit(view.bias)) + F.lit(view.shift)


def _calibrate(view: View, column: str, held: DataFrame) -> View:
    """Platt scaling on rows that weren't used for fitting; the raw scale where they hold one class only."""
    rows = held.select(F.array(_logit(view, column)).alias("z"), "y", F.lit(1.0).alias("w"))
    if rows.select("y").distinct().count() < 2:
        return view
    scale = _fit_view(rows, "z", 1)
    return View(view.weights, view.bias, max(0.0, float(scale.weights[0])), scale.bias)


def _telling_words(train: DataFrame) -> tuple[str, ...]:
    """At most WORDS words whose documents differ most from all in their share of bad ones; train: text, y."""
    total = train.agg(F.count("*"), F.avg((F.col("y") == 0).cast("double"))).first()
    if not total[0] or not 0 < total[1] < 1:
        return ()
    counts = train.select((F.col("y") == 0).cast("int").alias("bad"), F.explode(_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    apart = F.pow(F.col("bad") - F.col("n") * F.lit(total[1]), F.lit(2)) / F.col("n") / F.lit(total[1] * (1 - total[1]))
    return tuple(r["word"] for r in counts.filter((F.col("n") >= WORD_ROWS) & (apart >= WORD_CHI)).orderBy(apart.desc(), "word").limit(WORDS).collect())


def _scorer(model: CoTrained, names: list[str], finish):
    """A struct of doubles that ``finish`` makes of both views' log-odds."""
    places = model.places

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))
    def judged(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        take_turn("quality")
        a = model.content.logits(np.array([content_features(t) + word_features(t, places) for t in text]).reshape(-1, CONTENT_SIZE + len(places)))
        b = model.metadata.logits(np.array([metadata_features(*x) for x in zip(lang, source, n_chars, strict=True)]).reshape(-1, METADATA_SIZE))
        return pd.DataFrame(dict(zip(names, finish(a, b), strict=True)))

    return judged


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> CoTrained | None:
    """The co-trained views, or None without any labelled document.

    ``labelled_rows`` bounds the labelled rows that are fitted on: the documents with the smallest hashes of their ids.
    In each round all documents are scored, and ``pool_rows`` pseudo-labels at most are drawn for a view, by hash among
    the confident guesses on unlabelled documents. Repeated labels of a document count once, the worst winning; labels with
    null ids, or null quality and not toxic, are left out.
    """
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    label = F.when(toxic, F.lit(0)).otherwise(F.col("quality").cast("int"))
    known = labels.select("doc_id", label.alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = _columns(docs).filter(F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = rows.select("doc_id").distinct().join(known, "doc_id").withColumn("order", order).orderBy("order", "doc_id").limit(labelled_rows)
    chosen = stored(chosen, "quality-chosen")  # at most labelled_rows rows of three numbers
    fitted = F.pmod("order", F.lit(5)) != 0
    labelled = rows.join(F.broadcast(chosen), "doc_id")
    words = _telling_words(labelled.filter(fitted))
    places = {word: i for i, word in enumerate(words)}
    size = CONTENT_SIZE + len(words)

    def featured(some: DataFrame, *kept: str) -> DataFrame:
        out = some.withColumn("f", _both(places)).select("doc_id", *kept, F.col("f.content").alias("content"), F.col("f.metadata").alias("metadata"))
        return stored(out, "quality-sample").coalesce(4)

    sample = featured(labelled, "y", "order").cache()
    held = sample.filter(~fitted)
    train = sample.filter(fitted).select("doc_id", "y", "content", "metadata", F.lit(1.0).alias("w"))
    if train.limit(1).count() == 0:
        sample.unpersist()
        return None
    share = float(train.agg(F.avg("y")).first()[0])
    share = min(max(share, 0.01), 0.99)
    prior = float(np.log(share / (1 - share)))
    content, metadata = _fit_view(train, "content", size), _fit_view(train, "metadata", METADATA_SIZE)
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    for _ in range(rounds):
        judged = _scorer(CoTrained(content, metadata, prior, words), ["content", "metadata"], lambda a, b: (a, b))
        guesses = stored(rows.select("doc_id", judged("text", "lang", "source", "n_chars").alias("z")).select("doc_id", "z.content", "z.metadata").join(known, "doc_id", "left_anti"), "quality-guesses").withColumn("order", order)

        def drawn(view: str) -> DataFrame:
            found = [guesses.filter(c).orderBy("order", "doc_id").limit(pool_rows // 2).select("doc_id", F.lit(y).alias("y"), F.lit(view).alias("by")) for c, y in ((F.col(view) >= sure, 1), (F.col(view) <= -sure, 0))]  # noqa: B023
            return found[0].unionByName(found[1]).dropDuplicates(["doc_id"])

        picks = stored(drawn("content").unionByName(drawn("metadata")), "quality-picks")  # at most 2 * pool_rows rows
        pseudo = featured(rows.join(F.broadcast(picks), "doc_id"), "y", "by").withColumn("w", F.lit(0.25))
        by = lambda view: train.unionByName(pseudo.filter(F.col("by") == view).drop("by"))  # noqa: B023, E731
        content, metadata = _fit_view(by("metadata"), "content", size), _fit_view(by("content"), "metadata", METADATA_SIZE)
    content, metadata = _calibrate(content, "content", held), _calibrate(metadata, "metadata", held)
    sample.unpersist()
    return CoTrained(content, metadata, prior, words)


def score(docs: DataFrame, model: CoTrained | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds ``content_score``, ``metadata_score``, ``score`` (probabilities of good quality) and ``keep``.

    Without a model the scores are null and everything is kept.
    """
    names = ["content_score", "metadata_score", "score", "keep"]
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in names[:3]} | {"keep": F.lit(True)})
    judged = _scorer(model, names[:3], lambda a, b: [1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (a, b, a + b - model.prior)])
    read = [(F.col(c) if c in docs.columns else F.lit(None)).cast(k) for c, k in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "double"))]
    out = docs.withColumn("_judged", judged(*read))
    return out.withColumns({c: F.col(f"_judged.{c}") for c in names[:3]}).withColumn("keep", F.col("score") >= keep_from).drop("_judged")


def classify_quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` with both views' calibrated scores, the combined score and ``keep``.

    Null text is scored as an empty text, null metadata has its own class. Empty tables give an empty result. Further
    columns pass through; those named as a result column are replaced.
    """
    return score(docs, fit(docs, labels, **bounds))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify_quality(docs, labels).select("doc_id", "content_score", "metadata_score", "score", "keep")
