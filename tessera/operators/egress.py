"""What may leave: partition, scope rules, the gate, audit reads (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SECRETS, redaction_counts


def partition_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sendable, withheld); an unknown flag withholds."""
    flag = F.coalesce("no_egress", F.lit(True))
    return items.filter(~flag), items.filter(flag)


def scoped(externals: DataFrame, rules: DataFrame) -> DataFrame:
    """externals with ``scoped``: a rule (source_type, match) holds it back. Issues match by project key, pages by host;
    other types never. What can't be compared counts as a match."""
    key = F.when(F.col("source_type") == "jira", F.regexp_extract("external_id", r"^(.*)-\d+$", 1)).when(F.col("source_type") == "web", F.lower(F.regexp_extract("external_id", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    wanted = rules.filter(F.col("source_type").isin("jira", "web")).select("source_type", F.when(F.col("source_type") == "web", F.lower("match")).otherwise(F.col("match")).alias("_key"), F.lit(True).alias("_hit")).distinct()
    rows = externals.withColumn("_key", key).join(wanted, ["source_type", "_key"], "left")
    broken = F.col("source_type").isin("jira", "web") & F.col("external_id").isNull()
    return rows.withColumn("scoped", F.coalesce(F.col("_hit"), F.lit(False)) | F.coalesce(broken, F.lit(True))).drop("_key", "_hit")


def gate(items: DataFrame, patterns: dict[str, str] = SECRETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(redacted items to send, items withheld, audit): items are batch_id, ord, target_id, text, no_egress; a batch may hold any
    number of passages of a target.

    The audit has a row for each passage sent: batch_id, ord, target_id, spans (masked in it). It stays long, so a batch of any
    size needs no array; audit_rows makes the log's row of each batch.
    """
    send, held = partition_items(items)
    masked = redaction_counts(send, "text", patterns).withColumn("spans", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x))
    return masked.drop("text", "counts", "spans").withColumnRenamed("redacted", "text"), held, masked.select("batch_id", "ord", "target_id", "spans")


def audit_targets(audit: DataFrame) -> DataFrame:
    """(batch_id, target_id, passages, spans) from the audit of ``gate``: spans are those of the target's last passage, in order,
    that has any."""
    return audit.groupBy("batch_id", "target_id").agg(F.count("*").alias("passages"), F.coalesce(F.max_by("spans", F.when(F.col("spans") > 0, F.col("ord"))), F.lit(0).cast("long")).alias("spans"))


def audit_rows(audit: DataFrame, purpose: str, model: str) -> DataFrame:
    """The log's row of each batch: sent_targets in order, one for each passage, and redactions, a map from target to spans as
    in audit_targets, null where nothing was masked. The arrays are as long as the batch, which is one answer's context."""
    sent = audit.groupBy("batch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_id"))), lambda x: x["target_id"]).alias("sent_targets"))
    masked = audit_targets(audit).filter("spans > 0").groupBy("batch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target_id", "spans")))).alias("redactions"))
    return sent.join(masked, "batch_id", "left").select("batch_id", F.lit(purpose).alias("purpose"), F.lit(model).alias("model"), "sent_targets", "redactions")


def list_log(log: DataFrame, purpose: str | None = None) -> DataFrame:
    return (log if purpose is None else log.filter(F.col("purpose") == purpose)).orderBy("id")


def purpose_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("purpose").agg(F.count("*").alias("n"))
