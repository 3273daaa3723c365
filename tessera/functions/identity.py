"""Content keys: hashes of framed fields."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST_BYTES = 16


def framed(*fields: Column) -> Column:
    """Each field after its length in UTF-8 bytes, eight bytes big-endian; null counts as empty."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    parts = [x for f in texts for x in (F.unhex(F.lpad(F.hex(F.octet_length(f).cast("long")), 16, "0")), F.encode(f, "UTF-8"))]
    return F.concat(*parts)


def md5_key(*fields: Column) -> Column:
    return F.md5(framed(*fields))


def sha256_key(*fields: Column) -> Column:
    return F.sha2(framed(*fields), 256)


def content_key(*fields: str) -> str:
    """The blake2b key of framed fields, 128 bits in hexadecimal."""
    digest = hashlib.blake2b(digest_size=DIGEST_BYTES)
    for field in fields:
        raw = field.encode("utf-8")
        digest.update(len(raw).to_bytes(8, "big") + raw)
    return digest.hexdigest()


def blake2b_key(*fields: Column) -> Column:
    """The blake2b key as a column."""

    @F.pandas_udf(T.StringType())
    def key(frames: pd.Series) -> pd.Series:
        return frames.map(lambda x: hashlib.blake2b(x, digest_size=DIGEST_BYTES).hexdigest())

    return key(framed(*fields))
