"""The stored keyword index against a plain version of covers, phrases, policy and what is read."""

import random
import re

from pyspark.sql import functions as F

from corvane.operators import keyword_index

POLICY = [("a", 1), ("b", 0)]


def rows():
    r = random.Random(9)
    vocabulary = ["ref", "by", "nc", "v2", "the", "worker", "by-nc", "BY_NC", "über", "7", "by nc by nc", "file/path.py"]
    chunks = [(i, r.choice("abc"), r.randrange(3), r.choice([None, "Head by"]), " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for i in range(120)]
    return chunks + [(500, "a", 0, None, None), (501, "a", 0, None, ""), (502, "a", None, None, "by nc"), (503, None, 0, None, "by nc"), (504, "a", 0, "by", "nc"), (505, "a", 0, None, "x " * 30_000 + "by nc")]


words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]


def plain(terms, ceilings):
    phrases = {tuple(words(t)) for t in terms} - {()}
    found = []
    for key, source, rank, heading, content in rows():
        if source not in ceilings or rank is None or rank > ceilings[source]:
            continue
        ws = words(f"{heading or ''} {content or ''}")
        windows = {(i, i + len(p) - 1) for p in phrases for i in range(len(ws)) if tuple(ws[i : i + len(p)]) == p}
        least = [w for w in windows if not any(v != w and v[0] >= w[0] and v[1] <= w[1] for v in windows)]
        if least:
            found.append((-len(least), key))
    return [(key, -n, i + 1) for i, (n, key) in enumerate(sorted(found)[:20])]


def test_search(spark, tmp_path):
    chunks = spark.createDataFrame(rows(), "chunk_id long, source_id string, classification_rank int, heading string, content string").repartition(3)
    folder = keyword_index.write_index(chunks, f"file://{tmp_path}/index")
    policy = spark.createDataFrame(POLICY, "source_id string, ceiling int")
    asked = [["by-nc"], ["by-nc", "nc"], ["by-nc", "by", "worker", "by-nc"], ["by nc by"], ["über", "path.py"], ["--", ""], [], ["nothing-here"], ["the ref", "ref the ref"]]
    for terms in asked:
        got = [tuple(r) for r in keyword_index.find(spark, folder, terms, policy).orderBy("rank").select("chunk_id", "covers", "rank").collect()]
        assert got == plain(terms, dict(POLICY)), terms
    searches = spark.createDataFrame([(i, x) for i, x in enumerate(asked)] + [(99, None)], "search int, terms array<string>")
    many = keyword_index.search(keyword_index.read_index(spark, folder, policy), searches).orderBy("search", "rank").collect()
    assert [(r.search, r.chunk_id, r.covers, r.rank) for r in many] == [(i, *x) for i, terms in enumerate(asked) for x in plain(terms, dict(POLICY))]
    assert keyword_index.find(spark, folder, ["by-nc"], spark.createDataFrame([], "source_id string, ceiling int")).count() == 0


def test_only_folders_of_the_words_are_read(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(300)], "chunk_id long, content string")
    folder = keyword_index.write_index(chunks, f"file://{tmp_path}/index")
    found = keyword_index.find(spark, folder, ["w7"])
    assert sorted(r.chunk_id for r in found.collect()) == [6, 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan or "EqualTo(token" in plan
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert spark.read.parquet(folder).where("token = 'w7'").select("bucket").distinct().count() == 1


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, content string")
    index = keyword_index.postings(none)
    assert index.count() == 0 and keyword_index.search(index, spark.createDataFrame([(1, ["a"])], "search int, terms array<string>")).count() == 0


def test_covers(spark):
    frame = spark.createDataFrame([([(3, 1), (3, 3), (5, 4), (6, 2)],), ([],)], "w array<struct<last:int,first:int>>")
    assert [r[0] for r in frame.select(keyword_index.covers(F.col("w"))).collect()] == [2, 0]


def test_hybrid_search_with_the_index(spark, tmp_path):
    from corvane.operators import retrieval

    r = random.Random(3)
    chunks = spark.createDataFrame([(*row, [r.random() - 0.5 for _ in range(4)]) for row in rows()], "chunk_id long, source_id string, classification_rank int, heading string, content string, embedding array<double>")
    folder = keyword_index.write_index(chunks, f"file://{tmp_path}/index")
    terms, query = ["by-nc", "worker"], [0.3, -0.2, 0.9, 0.1]
    same = lambda found: [tuple(x) for x in found.select("chunk_id", "via", F.round("order_score", 9)).collect()]
    got = same(retrieval.hybrid_search(chunks, query, terms, 15, matches=keyword_index.find(spark, folder, terms)))
    assert got == same(retrieval.hybrid_search(chunks, query, terms, 15)) and {v for _, v, _ in got} >= {"both", "vector"}
