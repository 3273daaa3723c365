"""Passages, redaction and file units (C)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import passages as cut
from ..functions.recovery import let_go

# The patterns of secrets, in the order they are applied.
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
    "aws_key_id": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "github_fine_token": r"github_pat_[0-9A-Za-z_]{82}",
    "slack_token": r"xox[baprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"(?:sk|rk)_live_[0-9A-Za-z]{24,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "model_key": r"sk-ant-[0-9A-Za-z_-]{20,}",
}
#: A further pattern for corpora with ``token = "<hex>"`` assignments.
TOKEN_ASSIGNMENT = {"token_assignment": r"token = \"[0-9a-f]+\""}
MASK = "[redacted]"

#: Characters of passages and parent blocks that a worker gives back at once; a batch ends with the passage that reaches them.
BATCH_CHARS = 4_000_000
_UNITS = T.ArrayType(T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType()), T.StructField("text", T.StringType())]))


def chunk(bodies: DataFrame, most_tokens: int = cut.MOST_TOKENS, overlap: int = cut.OVERLAP, parents: str | None = "each") -> DataFrame:
    """(target_version, body) -> passages (passage_id, target_version, ord, char_start, char_end, text, parent_block).

    A body is cut where it lies: no shuffle, however long it is. With ``parents`` "first", a section is given once, in linear size:
    ``section`` is the ord of its first passage, and there ``section_text`` is the parent block, null where it is the passage's
    text. With None there are no parent blocks.
    """
    if parents not in ("each", "first", None):
        raise ValueError(f"no such parents: {parents}")
    more = {"each": ", parent_block string", "first": ", section int, section_text string", None: ""}[parents]
    kind = bodies.schema["target_version"].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), *{"each": [pa.string()], "first": [pa.int32(), pa.string()], None: []}[parents]]

    def rows(body: str) -> Iterator[tuple]:
        found, edges = cut.spans(body, most_tokens, overlap)
        first: dict[int, int] = {}
        whole: dict[int, str] = {}  # the section at hand
        for k, (a, b, n) in enumerate(found):
            text = body[a:b]
            if parents is None:
                yield k, a, b, text
                continue
            new = first.setdefault(n, k) == k
            if new:
                whole = {n: body[edges[n] : edges[n + 1]].strip()}
            if parents == "each":
                yield k, a, b, text, whole[n]
            else:
                yield k, a, b, text, first[n], whole[n] if new and whole[n] != text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["target_version", "ord", "char_start", "char_end", "text", *[x.split()[0] for x in more.split(", ")[1:]]]
            at: list[int] = []
            out: list[tuple] = []
            chars = 0
            for i, body in enumerate(batch.column(1)):
                for row in rows(body.as_py() or ""):
                    at.append(i)
                    out.append(row)
                    chars += len(row[3]) + len(row[-1] or "" if parents else "")
                    if chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, zip(*out, strict=True), types)], names)
                        at, out, chars = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, zip(*out, strict=True), types)], names)
        let_go()

    found = bodies.select("target_version", "body").mapInArrow(run, f"target_version {kind}, ord int, char_start int, char_end int, text string{more}")
    return found.withColumn("passage_id", F.concat_ws(":", "target_version", "ord"))


def _any_of(text: Column, patterns: dict[str, str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns.values())) if patterns else F.lit(False)


def redact(text: Column, patterns: dict[str, str] = SECRETS) -> Column:
    """The text with each pattern's matches masked, one pattern after the other; texts that no pattern hits are read once."""
    now = text
    for pattern in patterns.values():
        now = F.regexp_replace(now, pattern, MASK)
    return F.when(_any_of(text, patterns), now).otherwise(text)


def redaction_counts(rows: DataFrame, text: str = "text", patterns: dict[str, str] = SECRETS) -> DataFrame:
    """``rows`` with ``redacted`` and ``counts``, a map of pattern name to spans masked (patterns without a span left out)."""
    now, counts = F.col(text), []
    for name, pattern in patterns.items():
        counts.append(F.struct(F.lit(name).alias("key"), F.regexp_count(now, F.lit(pattern)).cast("long").alias("value")))
        now = F.regexp_replace(now, pattern, MASK)
    hit, none = _any_of(F.col(text), patterns), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    found = F.filter(F.array(*counts), lambda c: c["value"] > 0)
    return rows.withColumns({"redacted": F.when(hit, now).otherwise(F.col(text)), "counts": F.when(hit, F.map_from_entries(found)).otherwise(none)})


def redaction_audit(rows: DataFrame, by: str, text: str = "text", patterns: dict[str, str] = SECRETS) -> DataFrame:
    """(by, pattern, spans, documents) over a corpus."""
    each = redaction_counts(rows, text, patterns).select(by, F.explode("counts").alias("pattern", "n"))
    return each.groupBy(by, "pattern").agg(F.sum("n").alias("spans"), F.count("*").alias("documents"))


def index_text(bodies: DataFrame, patterns: dict[str, str] = SECRETS, most_tokens: int = cut.MOST_TOKENS, overlap: int = cut.OVERLAP, parents: str | None = "each") -> DataFrame:
    """Passages of redacted bodies: masking comes first, so offsets are those of the masked text."""
    return chunk(bodies.select("target_version", redact(F.col("body"), patterns).alias("body")), most_tokens, overlap, parents)


def file_units(files: DataFrame, most_bytes: int = cut.UNIT_BYTES, process_names: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) -> (path, class, first_line, last_line, text) of each unit. A file is a 'decision-record' unless its name
    without ending is among ``process_names``, which are 'reference/process'."""

    @F.pandas_udf(_UNITS)
    def cut_up(texts: pd.Series) -> pd.Series:
        return pd.Series([cut.units(t, most_bytes) for t in texts], dtype=object)

    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    kind = F.when(name.isin(*process_names), "reference/process").otherwise("decision-record") if process_names else F.lit("decision-record")
    return files.select("path", kind.alias("class"), F.explode(cut_up("text")).alias("u")).select("path", "class", "u.*")
