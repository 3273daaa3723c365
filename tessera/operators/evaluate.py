"""Retrieval and answer evaluation (K).

golden(item_id, question, relevant: array of target ids, citations: array of struct(target_id, quoted_span)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import flat


def load_golden(questions: DataFrame, citations: DataFrame, notes: DataFrame) -> DataFrame:
    """golden from questions (item_id, question), citations (item_id, n, note_id, quoted_span) and notes (note_id,
    head_version_id): each citation names the note's head version, which is relevant; a question without citations has
    nothing relevant and must be abstained from. A citation of an unknown note is an error."""
    known = citations.join(notes.select("note_id", F.col("head_version_id").alias("target_id")), "note_id", "left")
    wrong = F.raise_error(F.concat(F.lit("a golden citation names an unknown note: "), F.coalesce("note_id", F.lit("null")))).cast("string")
    known = known.withColumn("target_id", F.coalesce("target_id", wrong))
    cited = known.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("n", "target_id", "quoted_span"))).alias("c"))
    rows = questions.select("item_id", "question").join(cited, "item_id", "left")
    pairs = F.transform("c", lambda c: F.struct(c["target_id"].alias("target_id"), c["quoted_span"].alias("quoted_span")))
    return rows.select(
        "item_id", "question", F.coalesce(F.array_sort(F.array_distinct(F.col("c.target_id"))), F.array().cast("array<string>")).alias("relevant"),
        F.coalesce(pairs, F.array().cast("array<struct<target_id:string,quoted_span:string>>")).alias("citations"),
    )


def check_golden(golden: DataFrame, bodies: DataFrame) -> DataFrame:
    """(item_id, target_id, problem): relevant or cited ids that are unknown, spans that their body doesn't have."""
    ids = golden.select("item_id", F.explode(F.array_union("relevant", F.transform("citations", lambda c: c["target_id"]))).alias("target_id"))
    unknown = ids.join(bodies.select("target_id"), "target_id", "left_anti").select("item_id", "target_id", F.lit("unknown").alias("problem"))
    cited = golden.select("item_id", F.explode("citations").alias("c")).select("item_id", "c.*").join(bodies, "target_id")
    missing = cited.filter(~(F.contains("body", "quoted_span") | F.contains(flat(F.col("body")), flat(F.col("quoted_span"))))).select("item_id", "target_id", F.lit("span").alias("problem"))
    return unknown.unionByName(missing).distinct()


def recall_at_k(golden: DataFrame, retrieved: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, recall) of items that can be answered: the share of relevant ids among the first k retrieved."""
    found = retrieved.filter(F.col("rank") <= k).groupBy(F.col("query_id").alias("item_id")).agg(F.collect_set("target_version").alias("found"))
    rows = golden.filter(F.size("relevant") > 0).join(found, "item_id", "left")
    hit = F.size(F.array_intersect(F.array_distinct("relevant"), F.coalesce("found", F.array().cast("array<string>"))))
    return rows.select("item_id", (hit / F.size(F.array_distinct("relevant"))).alias("recall"))


def citation_accuracy(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """(item_id, accurate) of items that can be answered: something is cited, and nothing but relevant ids. answers:
    item_id, cited (array), abstained."""
    rows = golden.filter(F.size("relevant") > 0).join(answers, "item_id", "left")
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    return rows.select("item_id", ((F.size(cited) > 0) & (F.size(F.array_except(cited, "relevant")) == 0)).alias("accurate"))


def abstention_accuracy(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """(item_id, right): abstained just where nothing is relevant; a missing answer abstains."""
    rows = golden.join(answers, "item_id", "left")
    return rows.select("item_id", (F.coalesce("abstained", F.lit(True)) == (F.size("relevant") == 0)).alias("right"))


def evaluate(golden: DataFrame, retrieved: DataFrame, answers: DataFrame, k: int = 20) -> DataFrame:
    """One row: items, recall, citation_accuracy, abstention_accuracy; a mean over nothing is 0."""
    mean = lambda df, c, name: df.agg(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(name))
    out = golden.agg(F.count("*").alias("items"))
    for part in (mean(recall_at_k(golden, retrieved, k), "recall", "recall"), mean(citation_accuracy(golden, answers), "accurate", "citation_accuracy"), mean(abstention_accuracy(golden, answers), "right", "abstention_accuracy")):
        out = out.crossJoin(part)  # one row each
    return out
