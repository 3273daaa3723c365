"""Claims: span checks, the gate, citations (F).

Tables: claims(answer_id, claim_id, text), supports(claim_id, n, target_id, quoted_span), bodies(target_id, body).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import words
from ..functions.urls import spans

# Words that carry no payload, words that negate.
GLUE = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "am")
NEGATIONS = ("not", "no", "never", "cannot", "nothing", "nobody", "none", "neither", "nor", "without")
ENTAILED_FROM = 0.9


def flat(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def spans_verified(supports: DataFrame, bodies: DataFrame) -> DataFrame:
    """(claim_id, verified): every quoted span occurs in its body, as it is or up to white space; no body, no proof."""
    joined = supports.join(bodies, "target_id", "left")
    found = F.coalesce(F.contains("body", "quoted_span") | F.contains(flat(F.col("body")), flat(F.col("quoted_span"))), F.lit(False))
    return joined.groupBy("claim_id").agg(F.bool_and(found).alias("verified"))


def span_place(span: Column, body: Column, hint: Column | None = None) -> Column:
    """struct<start, end> of where a span stands in a body, null if nowhere or if the span is empty.

    Without a hint: the first place where it stands as it is, else the first up to white space. With one: of all places of
    both kinds the one that starts nearest to it; exact ones first among equally near. Offsets count code points.
    """
    words_ = F.filter(F.split(span, r"(?U)\s+"), lambda w: w != "")
    quoted = lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    loose = F.when(F.size(words_) > 0, F.concat(F.lit("(?U)"), F.array_join(F.transform(words_, quoted), r"\s+")))
    place = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    at = F.call_function("instr", body, span)
    gap = F.length(F.get(F.split(body, loose, 2), F.lit(0)))
    loosely = F.when(gap < F.length(body), place(gap, gap + F.length(F.regexp_substr(body, loose))))
    first = F.when(at > 0, place(at - 1, at - 1 + F.length(span))).otherwise(loosely)
    given = span.isNotNull() & (span != "") & body.isNotNull()
    if hint is None:
        return F.when(given, first)
    # a split before every place of the span: its pieces end where the span starts
    pieces = F.split(body, F.concat(F.lit("(?="), quoted(span), F.lit(")")), -1)
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + F.length(x)))
    starts = F.filter(ends, lambda i: F.substring(body, i + 1, F.length(span)) == span)
    near = lambda start, kind, end: F.struct(F.abs(start - hint).alias("far"), F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    exact = F.transform(starts, lambda i: near(i, 0, i + F.length(span)))
    others = F.when(loose.isNotNull(), F.transform(spans(body, loose), lambda x: near(x["start"], 1, x["end"]))).otherwise(F.array().cast("array<struct<far:int,kind:int,start:int,end:int>>"))
    best = F.array_min(F.concat(exact, others))
    return F.when(given & hint.isNull(), first).when(given & best.isNotNull(), place(best["start"], best["end"]))


def locate_spans(supports: DataFrame, bodies: DataFrame) -> DataFrame:
    """supports with ``start`` and ``end`` in the body (null if the span isn't there); a ``hint`` column is used if given."""
    hint = F.col("hint").cast("int") if "hint" in supports.columns else None
    rows = supports.join(bodies, "target_id", "left").withColumn("_s", span_place(F.col("quoted_span"), F.col("body"), hint))
    return rows.select(*supports.columns, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))


def negations(text: Column) -> Column:
    """The negating words and contractions of a text."""
    contracted = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+n['’]t)\b"), F.lit(1))
    return F.array_union(F.array_intersect(words(text), F.array(*map(F.lit, NEGATIONS))), contracted)


def coupled(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """(claim_id, coupled): some one span has all words of the claim but glue, and no negation that the claim lacks."""
    own = claims.select("claim_id", F.array_except(words(F.col("text")), F.array(*map(F.lit, GLUE))).alias("payload"), negations(F.col("text")).alias("cues"))
    rows = own.join(supports.select("claim_id", words(F.col("quoted_span")).alias("has"), negations(F.col("quoted_span")).alias("theirs")), "claim_id", "left")
    fits = (F.size("payload") > 0) & (F.size(F.array_except("payload", "has")) == 0) & (F.size(F.array_except("theirs", "cues")) == 0)
    return rows.groupBy("claim_id").agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("coupled"))


def word_share(premises: pd.Series, claims: pd.Series) -> pd.Series:
    """The default entailment scorer: the share of the claim's words that the premise has."""
    out = []
    for p, c in zip(premises, claims, strict=True):
        own = set((c or "").lower().split())
        out.append(len(own & set((p or "").lower().split())) / len(own) if own else 0.0)
    return pd.Series(out)


def entailed(claims: DataFrame, supports: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] = word_share, threshold: float = ENTAILED_FROM) -> DataFrame:
    """(claim_id, score, entailed): the joined spans of a claim against its text by a pluggable scorer."""

    @F.pandas_udf("double")
    def score(premise: pd.Series, claim: pd.Series) -> pd.Series:
        return scorer(premise, claim)

    joined = supports.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("n", "quoted_span"))).alias("s")).select("claim_id", F.concat_ws(" ", F.col("s.quoted_span")).alias("premise"))
    rows = claims.select("claim_id", "text").join(joined, "claim_id").withColumn("score", score("premise", "text"))
    return rows.select("claim_id", "score", (F.col("score") >= threshold).alias("entailed"))


def gate(claims: DataFrame, supports: DataFrame, bodies: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] = word_share, threshold: float = ENTAILED_FROM) -> tuple[DataFrame, DataFrame]:
    """((claim_id, answer_id, verified, coupled, survives), (answer_id, claims, surviving, abstains)). The scorer sees only
    claims that the cheaper tests leave open."""
    cheap = claims.join(spans_verified(supports, bodies), "claim_id", "left").join(coupled(claims, supports), "claim_id", "left")
    cheap = cheap.withColumns({"verified": F.coalesce("verified", F.lit(False)), "coupled": F.coalesce("coupled", F.lit(False))})
    open_ = cheap.filter("verified and not coupled")
    scored = entailed(open_.select("claim_id", "text"), supports.join(open_.select("claim_id"), "claim_id", "left_semi"), scorer, threshold)
    rows = cheap.join(scored.select("claim_id", "entailed"), "claim_id", "left")
    rows = rows.select("claim_id", "answer_id", "verified", "coupled", (F.col("verified") & (F.col("coupled") | F.coalesce("entailed", F.lit(False)))).alias("survives"))
    answers = rows.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if("survives").alias("surviving")).withColumn("abstains", F.col("surviving") == 0)
    return rows, answers


def synthesis_input(context: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Context (query_id, target_version, parent_block, rank) and targets (target_version, no_egress) into the distinct
    blocks to send, each at its best rank, and the targets withheld. Unknown targets are withheld."""
    rows = context.join(targets, "target_version", "left").withColumn("no_egress", F.coalesce("no_egress", F.lit(True)))
    send = rows.filter(~F.col("no_egress")).groupBy("query_id", "target_version", "parent_block").agg(F.min("rank").alias("rank"))
    return send, rows.filter("no_egress").select("query_id", "target_version").distinct()


def resolve_citations(supports: DataFrame, notes: DataFrame, versions: DataFrame, externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(target_id, title, owner_id, is_head, as_of) of each cited target; unknown ones have nulls."""
    from .state import first_line

    v = versions.join(notes.select("note_id", "head_version_id"), "note_id").select(F.col("version_id").alias("target_id"), first_line(F.col("body")).alias("v_title"), F.col("note_id").alias("v_owner"), (F.col("version_id") == F.col("head_version_id")).alias("v_head"), F.col("created").alias("v_at"))
    s = snapshots.join(externals.select("external_id", "head_snapshot_id"), "external_id").select(F.col("snapshot_id").alias("target_id"), first_line(F.col("body")).alias("s_title"), F.col("external_id").alias("s_owner"), (F.col("snapshot_id") == F.col("head_snapshot_id")).alias("s_head"), F.col("fetched_at").alias("s_at"))
    rows = supports.select("target_id").distinct().join(v, "target_id", "left").join(s, "target_id", "left")
    return rows.select("target_id", *[F.coalesce(f"v_{a}", f"s_{a}").alias(b) for a, b in (("title", "title"), ("owner", "owner_id"), ("head", "is_head"), ("at", "as_of"))])


def stamp_offsets(supports: DataFrame, context: DataFrame) -> DataFrame:
    """(claim_id, n, offset): where the span stands in the body, by the first passage of the target in context order that
    holds it. context: target_id, rank, char_start, text."""
    rows = supports.join(context, "target_id").withColumn("_s", span_place(F.col("quoted_span"), F.col("text"))).filter("_s.start is not null")
    return rows.groupBy("claim_id", "n").agg(F.min_by(F.col("char_start") + F.col("_s.start"), "rank").cast("long").alias("offset"))


def grouped_citations(supports: DataFrame, citations: DataFrame, bodies: DataFrame, around: int = 80) -> DataFrame:
    """(answer_id, owner_id, place, claim_no, n, target_id, around): the citations of each answer in the order in which they
    are shown. Claims go by what they cite, owners by first appearance in their answer; what resolves to no owner comes
    after them, in its own order, with a null owner and place. ``around`` is the text around a span, null where the span
    isn't found.

    supports: answer_id, claim_no, n, target_id, quoted_span, start, end. An answer's citations are one window; answers are
    independent.
    """
    rows = supports.join(citations.select("target_id", "owner_id"), "target_id", "left").join(bodies, "target_id", "left")
    begin = F.greatest(F.lit(0), F.col("start") - around)
    rows = rows.withColumn("around", F.substring(F.col("body"), begin + 1, F.col("end") + around - begin)).drop("body")
    first = F.min(F.struct("claim_no", "n")).over(Window.partitionBy("answer_id", "owner_id"))
    rows = rows.withColumn("first", F.when(F.col("owner_id").isNotNull(), first))
    place = F.dense_rank().over(Window.partitionBy("answer_id").orderBy(F.col("first").asc_nulls_last(), "owner_id"))
    return rows.select("answer_id", "owner_id", F.when(F.col("owner_id").isNotNull(), place).cast("long").alias("place"), "claim_no", "n", "target_id", "around")
