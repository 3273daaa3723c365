"""Corpus loader, log loader, replacing rows by key, payload export (A); keyed.py has the sink on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_corpus(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(note_id, body): the Markdown files of a folder, the note id being the name without its ending."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select(F.url_decode(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("note_id"), F.col("value").alias("body"))


def load_log(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def parse_props(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with the JSON of a column as a struct; rows whose JSON doesn't parse are skipped."""
    parsed = rows.withColumn("_p", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("_p").isNotNull()).withColumn(column, F.col("_p")).drop("_p")


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame, key: str = "target_version") -> DataFrame:
    """The table with all rows of the listed keys replaced by the new ones; a key without new rows is evicted. New rows of
    keys that aren't listed are left out, so that a second run changes nothing."""
    listed = keys.select(key).distinct()
    return old.join(listed, key, "left_anti").select(old.columns).unionByName(new.join(listed, key, "left_semi").select(old.columns))


def export_payloads(live_notes: DataFrame, edges: DataFrame, externals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(note_id, n, external_id, payload): the raw payload of the head of each external that a live note links to, numbered
    per note by external; empty payloads are numbered but left out."""
    links = edges.filter("source = 'user'").select(F.col("from_id").alias("note_id"), F.col("to_id").alias("external_id")).distinct().join(live_notes.select("note_id"), "note_id", "left_semi")
    heads = externals.join(snapshots.select(F.col("snapshot_id").alias("head_snapshot_id"), F.col("raw_payload").alias("payload")), "head_snapshot_id").select("external_id", "payload")
    rows = links.join(externals.select("external_id"), "external_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("note_id").orderBy("external_id")).cast("long"))
    return rows.join(heads, "external_id").filter("payload is not null and payload <> ''").select("note_id", "n", "external_id", "payload")
