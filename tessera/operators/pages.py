"""Snapshots of fetched pages (B10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import visible_text

LEAST_CHARS = 200
# Codes below 500 that are worth another try.
RETRIED = (408, 429)


def status_class(code: Column) -> Column:
    """transient (408, 429, 500 and above), tombstone (other codes from 400) or ok."""
    return F.when(code.isin(*RETRIED) | (code >= 500), "transient").when(code >= 400, "tombstone").otherwise("ok")


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """The visible text of a page, references decoded, white space as single spaces; scripts, styles, titles, templates and
    comments left out. Null counts as empty."""
    return pages.map(visible_text).astype(object)


def build_snapshots(fetches: DataFrame, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """((external_id, status, body, raw_payload), external ids to try again) from (external_id, code, html).

    A page without enough text, or with a final error, becomes a tombstone whose body names the reason.
    """
    rows = fetches.withColumns({"class": status_class(F.col("code")), "text": page_text(F.coalesce("html", F.lit("")))})
    reason = F.when(F.col("class") == "tombstone", F.concat(F.lit("http_"), "code")).when(F.length("text") < least_chars, "empty_extract")
    done = rows.filter("class <> 'transient'").withColumn("reason", reason)
    body = F.coalesce(F.concat(F.lit("[tombstone: "), "reason", F.lit("]")), "text")
    return done.select("external_id", F.when(F.col("reason").isNull(), "ok").otherwise("tombstone").alias("status"), body.alias("body"), F.col("html").alias("raw_payload")), rows.filter("class = 'transient'").select("external_id")
