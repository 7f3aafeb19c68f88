"""The pipeline's stages, one after the other, against brute-force versions of each on its own input."""

import collections

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

from .test_operators import base_counts, classes, removed


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.toPandas()
        if name != "best_fit_packing":
            assert docs.columns == columns
        text = dict(zip(before["doc_id"], before.get("text", [])))
        if name == "quality_rules":
            for i in after["doc_id"]:
                n, *_, again = base_counts(text[i])
                assert n >= 50 and 100 * again <= 50 * n
        elif name == "jaccard_join":
            assert sorted(after["doc_id"]) == sorted({c for _, _, c in classes(list(text.items()), 5, 4, 5)})
        elif name == "suffix_dedup":
            sizes = {i: n - gone for i, n, gone, *_ in removed(list(text.items()))}
            assert all(abs(len(t.encode()) - sizes[i]) <= 6 for i, t in zip(after["doc_id"], after["text"]))
        elif name == "pii":
            assert len(after) == len(before) and not after["text"].str.contains(r"@mail\d").any()
        else:
            assert set(after["doc_id"]) == set(before["doc_id"]) and (after.groupby("sequence_id")["length"].sum() <= 2048).all()
        before = after


def test_registered(spark):
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
