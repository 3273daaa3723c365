"""WARC archive with content addressing.

Payload bytes are stored once per strong digest (SHA-256), exact record headers apart from them. Reading joins both,
checks every payload against its digest and length, and puts the original records together again. Of records with equal
payloads of some size the one with the largest page_id is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

#: Payloads below this many bytes are always stored as responses.
LEAST_REVISIT_BYTES = 1000
WARC_DATE = "1970-01-01T00:00:00Z"
_EOL = "\r\n"


def _record_id(page_id: Column) -> Column:
    """A stable record id: a name-based UUID shape over the page's id."""
    h = F.sha2(F.concat(F.lit("page:"), page_id.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, digests, length, record type and exact header of each page's record; the payload is left out.

    Only digests and ids are shuffled: the largest page_id of each digest is a partial maximum, then a join.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    responses = base.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).groupBy("sha256").agg(F.max("page_id").alias("first_page"))
    joined = base.join(responses, "sha256", "left")
    revisit = F.col("first_page").isNotNull() & F.col("page_id").isNotNull() & (F.col("first_page") != F.col("page_id"))
    typed = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_page")))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))), F.lit(f"WARC-Date: {WARC_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.concat(F.lit("WARC-Refers-To: "), F.when(revisit, _record_id(F.col("first_page")))), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return typed.withColumn("header", F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL + _EOL))).drop("first_page")


def write(pages: DataFrame, folder: str) -> None:
    """Writes two tables: ``headers`` (a row per record, in page order within a file) and ``payloads`` (a row per distinct
    payload, its bytes kept from the page that is its response).

    Null html is an empty payload, very long ones are stored whole; a null url leaves the target line out. Rows with a null
    page_id get a response record of their own. Repeated page_ids give a record each; where they share the largest id of a
    payload, each is a response. An empty table gives empty archives. Further columns are ignored, also those named like
    one of the archive's.
    """
    found = records(pages)
    found.select("page_id", "sha256", "sha1", "payload_bytes", "record_type", "refers_to", "header").write.parquet(f"{folder}/headers")
    _once(pages).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def _once(pages: DataFrame) -> DataFrame:
    """(sha256, payload), a row per distinct payload: that of its largest page_id.

    Which page that is, is found on digests and ids alone. Payloads are then joined with it on digest and page, so the copies
    of a frequent payload lie apart; rows that repeat a page meet in the same partition and go there.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.coalesce("page_id", F.lit(-(2**63))).alias("page"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    kept = rows.groupBy("sha256").agg(F.max("page").alias("page"))
    return rows.join(kept.hint("merge"), ["sha256", "page"]).dropDuplicates(["sha256", "page"]).select("sha256", "payload")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records: page_id, header, block (what follows the header), payload, payload_bytes, payload_digest, record_type,
    refers_to.

    Each stored payload is measured and hashed once, where it lies, and joined with its records' headers. One that doesn't
    hash to its key, is missing, or hasn't the recorded length fails the read. A revisit's block is empty, its payload is
    that of the record it refers to. Where neither block nor payload is asked for, no payload is moved.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    wrong = lambda what: F.raise_error(F.concat(F.lit("damaged or missing payload "), what))
    found = payloads.select(
        F.col("sha256").alias("key"), "payload", F.octet_length("payload").cast("long").alias("found_bytes"),
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(wrong(F.col("sha256")).cast("string")).alias("found_digest"),
    )
    joined = headers.join(found, headers["sha256"] == found["key"], "left")
    sound = F.col("found_digest").isNotNull() & (F.col("found_bytes") == F.col("payload_bytes"))
    checked = lambda c, kind: F.when(sound, F.col(c)).otherwise(wrong(F.col("sha256")).cast(kind))
    type_line = F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1)
    return joined.select(
        "page_id", "header", F.when(type_line == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(checked("payload", "binary")).alias("block"), checked("payload", "binary").alias("payload"),
        checked("found_bytes", "long").alias("payload_bytes"), checked("found_digest", "string").alias("payload_digest"), type_line.alias("record_type"), "refers_to",
    )


def as_bytes(archive: DataFrame) -> DataFrame:
    """(page_id, record): each record as it stands in a WARC file."""
    return archive.select("page_id", F.concat(F.encode("header", "UTF-8"), "block", F.encode(F.lit(_EOL + _EOL), "UTF-8")).alias("record"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM r
"""
