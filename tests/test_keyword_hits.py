"""A posting is made within its row, a frequent word's hits are dealt over tasks, and groups of searches find the same."""

from corvane.operators import keyword_index
from pyspark.sql import functions as F


def test_postings_are_made_within_the_row(spark):
    chunks = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, None), (4, "x"), (1, "b a b c")], "chunk_id long, content string")
    found = keyword_index.postings(chunks)
    assert sorted((r.chunk_id, r.token, r.places, r.length) for r in found.collect()) == [(1, "a", [1], 4), (1, "b", [0, 2], 4), (1, "c", [3], 4), (4, "x", [0], 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "posexplode" not in plan


def test_a_frequent_word_is_dealt_by_chunk(spark, monkeypatch):
    texts = [(i, "all by nc " + f"w{i % 5} by-nc " * (i % 4)) for i in range(400)]
    index = keyword_index.postings(spark.createDataFrame(texts, "chunk_id long, content string")).cache()
    searches = spark.createDataFrame([(i, ["all", "by", f"w{i % 7}", "w1 by", "by nc by"]) for i in range(30)], "search long, terms array<string>")
    rows = lambda df: sorted(tuple(r) for r in df.select("search", "chunk_id", "covers", "rank").collect())
    whole = rows(keyword_index.search(index, searches, 7))
    asked = keyword_index.asked_of(index, searches)
    assert asked.select("token").distinct().count() == 8 and asked.count() < index.count() + 1
    monkeypatch.setattr(keyword_index, "GROUP_WORDS", 20)
    monkeypatch.setattr(keyword_index, "PART_HITS", 500)
    assert rows(keyword_index.search(asked, searches, 7)) == whole and len(whole) == 210
    one = searches.select("search", F.lit("all").alias("token"), keyword_index.bucket(F.lit("all")).alias("bucket"))
    plan = keyword_index._of_words(index, one, 7, "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(token" not in plan and "SortMergeJoin" not in plan
