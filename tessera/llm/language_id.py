"""Language identification with hyperdimensional profiles.

Every letter owns a fixed random +1/-1 vector. A trigram vector binds (multiplies) the vectors of its three letters, each
permuted (rotated) by its place in the trigram; a text vector bundles (adds) the trigram vectors of the whole text; a
language prototype bundles unit text vectors. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, take_turn

DIMENSIONS = 512
LETTER_SLOTS = 4096
UNKNOWN = "und"
_SEED = 20240229
_CACHED_TRIGRAMS = 12_000


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors rotated by two, one and no places (a letter's slot is its code point modulo LETTER_SLOTS), and a
    flag per code point that says if it is a letter."""
    base = np.random.default_rng(_SEED).integers(0, 2, (LETTER_SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1
    flags = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.roll(base, 2, 1), np.roll(base, 1, 1), base, flags


class _Encoder:
    """Text vectors; keeps the vectors of the trigrams met so far, a bounded number of them."""

    def __init__(self) -> None:
        self.two, self.one, self.base, self.is_letter = _letters()
        self.rows = np.empty((_CACHED_TRIGRAMS, DIMENSIONS), np.float32)
        self._forget()

    def _forget(self) -> None:
        self.codes, self.places = np.empty(0, np.int64), np.empty(0, np.int64)  # codes in order, and the row of each

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes >> 24, (codes >> 12) & 4095, codes & 4095
        return self.two[a] * self.one[b] * self.base[c]

    def _trigrams(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            fresh = codes[~known]
            if len(self.codes) + len(fresh) > _CACHED_TRIGRAMS:
                self._forget()
                fresh = codes
            n = len(self.codes)
            self.rows[n : n + len(fresh)] = self._vectors(fresh)
            where = np.searchsorted(self.codes, fresh)
            self.places = np.insert(self.places, where, np.arange(n, n + len(fresh)))
            self.codes = np.insert(self.codes, where, fresh)
            at = np.searchsorted(self.codes, codes)
        return self.rows[self.places[at]]

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None without a letter."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.is_letter[points]
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        slots = np.where(letter, points % LETTER_SLOTS, 32)[keep].astype(np.int64)
        slots = np.concatenate([[32], slots, [32]])
        codes, counts = np.unique((slots[:-2] << 24) | (slots[1:-1] << 12) | slots[2:], return_counts=True)
        total = np.zeros(DIMENSIONS, np.float32)
        for start in range(0, len(codes), 4096):
            part = slice(start, start + 4096)
            total += counts[part].astype(np.float32) @ self._trigrams(codes[part])
        size = float(np.linalg.norm(total))
        return total / size if size else None


@lru_cache(maxsize=1)
def _kept_encoder() -> _Encoder:
    return _Encoder()


def _encoder() -> _Encoder:
    take_turn("language_id", _kept_encoder.cache_clear)
    return _kept_encoder()


def in_training(doc_id: str = "doc_id") -> F.Column:
    """True for the documents whose label may be used: crc32 of the id as text modulo 4 is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            v = _encoder().vector(text)
            if v is not None:
                total[lang] = total[lang] + v if lang in total else v.astype(np.float64)
    yield pd.DataFrame({"lang": pd.Series(list(total), dtype=object), "bundle": [v.astype(np.float64).tobytes() for v in total.values()]})


def fit(docs: DataFrame, per_language: int = 3000) -> tuple[list[str], np.ndarray]:
    """Language codes and their prototypes, from labelled training documents.

    ``per_language`` bounds the sample: it is the expected number of documents drawn for each language, by a hash of the
    id, so the choice doesn't depend on how rows are partitioned.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sums: dict[str, np.ndarray] = {}
    drawn = labelled.filter(draw < limit[F.col("lang")]).select("lang", "text").repartition(8)
    for row in drawn.mapInPandas(_sums, "lang string, bundle binary").collect():
        sums[row["lang"]] = sums.get(row["lang"], 0) + np.frombuffer(row["bundle"], np.float64)
    langs = sorted(x for x, v in sums.items() if np.linalg.norm(v))
    return langs, np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs], np.float32).reshape(-1, DIMENSIONS)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the cosine, not below 0) to ``docs``; only the text is looked at."""

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for text in texts:
            v = _encoder().vector(text)
            if v is None or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            cosines = prototypes @ v
            k = int(np.argmax(cosines))
            names.append(langs[k])
            scores.append(min(1.0, max(0.0, float(cosines[k]))))
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores})

    clash = [c for c in docs.columns if c in ("lang_pred", "score", "_guess")]
    return docs.drop(*clash).withColumn("_guess", best("text")).withColumn("lang_pred", F.col("_guess.lang_pred")).withColumn("score", F.col("_guess.score")).drop("_guess")


def identify_languages(docs: DataFrame, per_language: int = 3000) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Null text, or text without a letter: ``und`` with score 0. Null ids count as not held out and are never learned from.
    Ties go to the code that sorts first. An empty table gives an empty result; without labels every text is ``und``.
    Further columns pass through; those named as a result column are replaced.
    """
    langs, prototypes = fit(docs, per_language)
    return predict(docs.drop("held_out"), langs, prototypes).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")
