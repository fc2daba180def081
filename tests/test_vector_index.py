"""The stored vector index against brute force: recall, policy before ranking, more lists where few rows are permitted, hot vectors."""

import os

import numpy as np
import pytest

from corvane.operators import vector_index

SCHEMA = "chunk_id long, source_id string, classification_rank int, embedding array<float>"


def table(n=3000, dim=16):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, dim))
    vectors = centres[r.integers(0, 30, n)] + 0.4 * r.normal(size=(n, dim))
    vectors[100:1100] = vectors[100]  # one common vector
    rows = [(i, "rare" if i % 200 == 7 else "abc"[i % 3], int(i % 4), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    return rows + [(9000, "a", 0, None), (9001, "a", 0, [0.0] * dim), (9002, None, 0, rows[0][3]), (9003, "a", None, rows[0][3])]


def brute(rows, vector, ceilings, k):
    q = np.array(vector) / np.linalg.norm(vector)
    part = [(key, np.array(v)) for key, s, c, v in rows if v is not None and s in ceilings and c is not None and c <= ceilings[s]]
    score = [(-round(float(v @ q / np.linalg.norm(v)) if v.any() else 0.0, 9), key) for key, v in part]
    return [key for _, key in sorted(score)[:k]]


@pytest.mark.parametrize("small", [False, True])
def test_recall_under_policy(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_index, "PART", 100)
        monkeypatch.setattr(vector_index, "ASKING", 7)
    rows = table()
    folder = vector_index.write_index(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/index")
    asked = [r for r in rows if r[0] % 50 == 0 and r[0] < 9000]
    searches = spark.createDataFrame([(r[0], r[3]) for r in asked] + [(77, None)], "search long, vector array<float>")
    for ceilings in ({"a": 2, "b": 3, "nowhere": 3}, {"rare": 3}, {"rare": 0}, {}):
        policy = spark.createDataFrame(list(ceilings.items()), "source_id string, ceiling int")
        found: dict = {}
        for r in vector_index.search(spark, folder, searches, policy, 10, vector_index.opened_for(spark, folder, searches, policy)).orderBy("search", "rank").collect():
            found.setdefault(r.search, []).append(r.key)
        want = {r[0]: brute(rows, r[3], ceilings, 10) for r in asked}
        # Nothing that isn't permitted, and as many rows as there can be, however few the policy lets through.
        assert all(len(found.get(q, [])) == len(w) for q, w in want.items()) and set(found) <= set(want)
        permitted = {r[0] for r in rows if r[1] in ceilings and r[2] is not None and r[2] <= ceilings[r[1]]}
        assert all(set(f) <= permitted and len(set(f)) == len(f) for f in found.values())
        hits = sum(len(set(found.get(q, [])) & set(w)) for q, w in want.items())
        assert hits >= 0.9 * sum(map(len, want.values())), (ceilings, hits)
        every = vector_index.search(spark, folder, searches, policy, 10, opened=1.0).orderBy("search", "rank").collect()
        assert [(r.search, r.key) for r in every] == [(q, key) for q, w in sorted(want.items()) for key in w]


def test_empty_and_unlike(spark, tmp_path):
    policy = spark.createDataFrame([("a", 3)], "source_id string, ceiling int")
    folder = vector_index.write_index(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert vector_index.search(spark, folder, spark.createDataFrame([(1, [1.0])], "search long, vector array<float>"), policy).count() == 0
    with pytest.raises(Exception, match="all are to have as many"):
        vector_index.write_index(spark.createDataFrame([(1, "a", 0, [1.0]), (2, "a", 0, [1.0, 2.0])], SCHEMA), f"file://{tmp_path}/two")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_of_the_query(spark):
    from corvane.plans import indexes
    from corvane.plans.queries import CEILINGS

    sf = "/root/testdata/sf0.01"
    found: dict = {}
    for r in indexes.vector_index_search(spark, sf).collect():
        found.setdefault(r.search, set()).add(r.chunk_id)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    rows = [(r.vec_id, source[r.vec_id], r.vec_id % 4, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.vec_id in source]
    want = {r[0]: brute(rows, r[3], dict(CEILINGS), 10) for r in rows if r[0] % 50 == 0}
    assert sum(len(found.get(q, set()) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
