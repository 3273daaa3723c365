"""URL filter: given host and path rules, and rules mined from labelled pages by FP-growth.

A URL becomes a set of tokens (host suffixes, host words, path parts, query keys). FP-growth finds token combinations that
are frequent among labelled URLs; those that foretell a bad label with enough support, confidence and lift become mined
rules. Rules are matched through an inverted index: each stands under its rarest token, is joined with the URLs that have
that token, and is then checked in full. Given rules win over mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Host, path prefix and verdict of the given rules.
GIVEN_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.002
MIN_ROWS = 20
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
BROADCAST_ROWS = 200_000
_BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def url_tokens(url: Column) -> Column:
    """The distinct tokens that mined rules are made of."""
    host, path = host_of(url), F.lower(path_of(url))
    marked = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.lower(url), r"\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            marked("domain=", F.filter(_suffixes(host), lambda s: s != host)),
            marked("word=", F.split(host, r"[.\-_]")),
            marked("path=", F.filter(F.split(path, r"[/.\-_]"), lambda x: ~x.rlike(r"^\d+$"))),
            marked("key=", F.transform(F.split(query, "&"), lambda kv: F.regexp_extract(kv, "^([^=]*)", 1))),
        )
    )


def _telling(baskets: DataFrame, least_rows: float) -> DataFrame:
    """(token, stands_for): the tokens that a rule may be made of, and the one that stands for each.

    A rule's tokens come with a bad page in at least ``least_rows`` baskets, so others can't be part of one. Of tokens that are in
    just the same baskets (a host and its words, the fixed parts of a shop's paths) the first stands for all: they make the
    same rules, and each would double the number of item sets. baskets: basket, items, bad.
    """
    each = baskets.select("bad", F.xxhash64("basket", F.lit(1)).alias("h1"), F.xxhash64("basket", F.lit(2)).alias("h2"), F.explode("items").alias("token"))
    marks = each.groupBy("token").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"), F.sum(F.col("h1") % (1 << 40)).alias("h1"), F.bit_xor("h2").alias("h2")).filter(F.col("bad") >= least_rows)
    first = marks.groupBy("n", "h1", "h2").agg(F.min("token").alias("stands_for"))
    return marks.join(first, ["n", "h1", "h2"]).select("token", "stands_for")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS) -> DataFrame:
    """(rule_tokens, confidence, support): token combinations that foretell a bad page.

    A page is bad where a label with its id has quality 0 or toxic 1; repeated labels count once, the worst winning, and
    repeated rows of a page and URL count once. A
    combination is left out if a smaller one of it foretells at least as well. Tokens that always come together count as one,
    the first of them. All labelled pages are mined.
    """
    bad = F.max(((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    baskets = pages.filter("page_id is not null and url is not null").select("page_id", "url").distinct().join(known, "page_id")
    baskets = stored(baskets.select(F.xxhash64("page_id", "url").alias("basket"), "bad", url_tokens(F.col("url")).alias("items")), "url-baskets")
    rows = baskets.count()
    if not rows:
        return baskets.sparkSession.createDataFrame([], "rule_tokens array<string>, confidence double, support double")
    support = max(min_support, min_rows / rows)
    telling = _telling(baskets, support * rows)
    kept = baskets.select("basket", "bad", F.explode("items").alias("token")).join(_sized(telling), "token").filter("token = stands_for")
    items = kept.groupBy("basket", "bad").agg(F.collect_set("token").alias("items"))  # at most a URL's own tokens
    left = baskets.select("basket", "bad").join(items.select("basket"), "basket", "left_anti").withColumn("items", F.array().cast("array<string>"))  # they count as baskets
    marked = items.unionByName(left).select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(stored(marked, "url-baskets"))
    rules = model.associationRules.filter(F.array_contains("consequent", _BAD) & (F.col("lift") >= min_lift))
    rules = stored(rules.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support"), "url-mined")
    smaller, larger = rules.select(F.col("rule_tokens").alias("s"), F.col("confidence").alias("c")), rules
    # the smaller rules of a rule stand under one of its tokens: an equality join, then the full test
    parts = larger.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("t"))
    heads = smaller.withColumn("t", F.get("s", F.lit(0)))
    beaten = parts.join(heads, "t").filter((F.size("s") < F.size("rule_tokens")) & (F.size(F.array_except("s", "rule_tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    return rules.join(beaten.select("rule_tokens").distinct(), "rule_tokens", "left_anti")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): the URLs that a mined rule fits, with the tokens of the most confident such rule."""
    sizes = rules.select(F.explode("rule_tokens").alias("t")).distinct()
    tokens = stored(urls.select("url", url_tokens(F.col("url")).alias("tokens")), "url-tokens")
    spread = tokens.select("url", F.explode("tokens").alias("t"))
    often = spread.join(_sized(sizes), "t").groupBy("t").agg(F.count("*").alias("n"))
    ranked = rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("t")).join(often, "t", "left").groupBy("rule_tokens", "confidence").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("rarest"))
    index = stored(ranked.select(F.col("rarest.t").alias("t"), "rule_tokens", "confidence"), "url-index")
    hits = tokens.select("url", "tokens", F.explode("tokens").alias("t")).join(_sized(index), "t").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("rule_tokens", " ").alias("tokens")))["tokens"].alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, given: tuple = GIVEN_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``mined`` and ``verdict``.

    A given rule fits its host and all hosts below it where the path starts with the rule's path; the longest fitting rule
    wins (ties: the one that sorts first). Without one the mined rules decide: block if any fits, else allow. Null urls and
    urls without ``://`` have an empty host and path, which no given rule fits. Distinct urls are judged once, so repeated
    rows agree. Empty tables give an empty result, or no mined rules. Columns named as a result column are replaced.
    """
    names = ["host", "path", "rule", "mined", "verdict"]
    pages = pages.drop(*names)
    spark = pages.sparkSession
    urls = stored(pages.filter("url is not null").select("url").distinct(), "urls")
    table_of = spark.createDataFrame([(h, p, f"{h}{p}", v) for h, p, v in given], "r_host string, r_path string, r string, v string")
    spread = urls.select("url", path_of(F.col("url")).alias("p"), F.explode(_suffixes(host_of(F.col("url")))).alias("r_host"))
    fits = spread.join(_sized(table_of), "r_host").filter(F.startswith("p", "r_path"))
    best = fits.groupBy("url").agg(F.min(F.struct(-F.length("r"), "r", "v")).alias("b")).select("url", F.col("b.r").alias("rule"), F.col("b.v").alias("given"))
    verdicts = urls.join(best, "url", "left").join(matched(urls, mine(pages, labels)), "url", "left")
    out = pages.join(verdicts, "url", "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("verdict", F.coalesce("given", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")))
    return out.select(*pages.columns, *names)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return judge_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict")
