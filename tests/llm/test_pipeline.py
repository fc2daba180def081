"""The pipeline, stage by stage, against what each stage should do with its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import mixing, pii
from test_shingles import components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", "src0", 7), (10**6 + 2, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(bad).unionByName(docs.limit(5))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs, spark.read.parquet(f"{tmp_path}/{name}")
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert before.count() - after.count() == 3 and after.where(~F.col("text").rlike(r"\p{L}")).count() == 0

    before, after = seen["near_dedup"]
    # Five words and a similarity of 0.8, by brute force over all pairs.
    want = {k for _, k in components([(r.doc_id, r.text) for r in before.collect()])}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)

    before, after = seen["pii"]
    assert before.count() == after.count() and pii.find(after).where(F.exists("pii", lambda x: x["kind"] == "email")).count() == 0
    clean = pii.find(before).where(F.size("pii") == 0).select("doc_id", "text")
    assert clean.exceptAll(after.select("doc_id", "text")).count() == 0

    before, after = seen["mixing"]
    plan = mixing.mix(before).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
    assert all(abs(r.n - r.target) <= 0.02 * r.target + mixing.BLOCK for r in plan)
    assert after.count() >= before.count() * 0.5

    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_with_clashing_columns_and_without_rows(spark):
    """Names that operators use within: such columns come through every stage as they were, and empty tables too."""
    own = ["size", "taken", "target", "source_size", "spans", "lang_pred", "score", "held_out", "pii", "component_id", "representative", "__row", "__text", "__set", "__order", "__i"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "a text without an id here", None, None, None), (3, None, "en", "src1", None)], docs.schema))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.select("doc_id", *own).collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for c in own), (name, r)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SF).count() == 0
