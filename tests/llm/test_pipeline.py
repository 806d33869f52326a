import os

import pytest

import __spark_entry__
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER).cache()
        seen.append((docs.select("doc_id").distinct().count(), out.select("doc_id").distinct().count()))
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.where("n_chars <> length(text)").count() == 0
        docs = out
    assert all(after <= before for before, after in seen) and seen[0][1] < seen[0][0]


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    at = {}
    for r in rows:
        at[r.sequence_id] = at.get(r.sequence_id, 0) + r.length
    assert rows and max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 1


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
