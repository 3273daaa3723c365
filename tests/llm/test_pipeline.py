"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.near_dedup import shingles


def test_stages_pass_on_what_they_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("score", F.lit(1))
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns, name
        gone = {r["doc_id"]: r["text"] for r in before.join(after.select("doc_id"), "doc_id", "left_anti").collect()}
        rows = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language":
            assert all(not any(c.isalpha() for c in t or "") for t in gone.values())
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert sum(labels.get(d) == 1 for d in gone) <= 0.02 * len(labels) and sum(labels.get(d) == 0 for d in rows) <= 0.05 * len(labels)
        if name == "near_dedup":
            sets = {d: shingles(t) for d, t in {**rows, **gone}.items()}

            def linked(a, b):
                i = len(np.intersect1d(sets[a], sets[b]))  # noqa: B023
                return i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i)  # noqa: B023

            kept = sorted(rows)
            assert not any(linked(a, b) for k, a in enumerate(kept) for b in kept[:k])
            assert all(any(linked(d, o) for o in sets if o < d) for d in gone)
        if name == "decontamination":
            assert all(any(b in t for b in benchmark) for t in gone.values()) and not any(b in t for t in rows.values() for b in benchmark)
        before = after
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()}
    assert set(out) == set(rows)
    for d, text in rows.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[d]["n_tokens"] == len(ids) and out[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_of_an_empty_table_and_awkward_rows(spark, sf_dir, tmp_path):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/a/{name}.parquet")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    odd = spark.createDataFrame([(None, "words without an id in them", None, None, None), (900001, None, None, None, None), (900002, "", "en", None, 0)], docs.schema)
    docs.limit(50).unionByName(odd).unionByName(docs.limit(5)).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()]
    assert 900001 not in ids and 900002 not in ids and len(ids) == len(set(ids)) > 30
