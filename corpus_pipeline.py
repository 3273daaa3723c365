"""A corpus pipeline: language, quality, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is stored as Parquet and read again as the next one's
documents. All but the last give the columns of ``documents``.

In every stage an empty table gives an empty result, texts of any length are read whole, and further columns pass through
(one named like a result column of the stage's operator comes out with the operator's values).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import digests
from tessera.llm.common import stored, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.language_id import UNKNOWN, identify_languages
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.quality import classify_quality


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters go.

    Nulls in other columns, the id included, keep no document out. Equal texts are judged alike, repeated rows stay repeated.
    """
    return identify_languages(docs).filter(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of this stage's documents, keeps.

    A null text is judged as an empty one, null language, source and length have classes of their own. Repeated rows are
    judged alike and stay repeated.
    """
    return classify_quality(docs, table(spark, sf_dir, "labels")).filter("keep").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates.

    First is the smallest doc_id. Null or wordless texts stand alone and stay. Of rows that share a doc_id one stays at most;
    rows with a null doc_id are linked with nothing and stay.
    """
    return near_duplicates(docs).filter("kept").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Rows with a null text or doc_id hold no passage that is found and stay; all rows of a doc_id go if one holds a passage.
    Null benchmark texts and ids match nothing; with an empty benchmark all documents stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of ids, and the digests of the ids and of the text that they decode to.

    A null text counts as empty: no ids, and the digests of nothing. Each row gives a row, repeated ones too.
    """
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("bpe", token_ids),
]

#: Classifiers have no SQL form; tests/llm holds the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
