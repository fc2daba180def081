"""The keyword index is written by more tasks where there is more content."""

from corvane.operators import keyword_index


def test_parts_grow_with_content(spark, monkeypatch):
    chunks = spark.range(300).selectExpr("id AS chunk_id", "concat('all w', id % 9, ' x', id) AS content")
    whole = keyword_index.postings(chunks, buckets=4)
    monkeypatch.setattr(keyword_index, "PART_BYTES", 100, raising=False)
    parts = keyword_index.postings(chunks, buckets=4)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(parts) == rows(whole) and parts.rdd.getNumPartitions() == 32
