"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where that setting is absent (a local session, as in tests) a folder of this process is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder.setdefault("base", tempfile.mkdtemp(prefix="spark-tessera-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a Parquet table into the shared folder and reads it back: lineage ends there."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[str, Callable[[], None]] = {}
_turn = [""]


def take_turn(name: str, let_go: Callable[[], None] | None = None) -> None:
    """Called in a Python worker before an operator works there. One worker serves stage after stage: when another operator's
    turn comes, what the ones before keep there is let go (each by its ``let_go``), as only one's caches fit."""
    if let_go is not None:
        _kept[name] = let_go
    if _turn[0] != name:
        _turn[0] = name
        for other, drop in _kept.items():
            if other != name:
                drop()
        gc.collect()
        pa.default_memory_pool().release_unused()


#: Characters of text that a worker takes apart at a time.
BATCH_CHARS = 2_000_000


def in_batches(texts: Iterable[str | None], chars: int = BATCH_CHARS) -> Iterable[list[str | None]]:
    """Runs of texts of some millions of characters."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def chosen_parts(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts of these sizes that lie side by side in ``flat``: those of the given numbers, side by side in turn, and where
    each ends."""
    taken = sizes[which]
    ends = np.cumsum(taken)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - taken), taken)
    return flat[at], ends
