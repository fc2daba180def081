"""Queries that do the whole of an operator's job, against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from corvane import registry


def test_longest_whole_description(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    same = "x" * 40
    rows = [(1, same, "en", "s"), (2, same + " longest of all", "en", "s"), (3, same + " long", "en", "s"), (4, "b", "de", "s"), (5, "c", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["longest_whole_description"](spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {(r.key, r.length, r.description_hash) for r in got} == {("en", 55, sha(rows[1][1])), ("de", 1, sha("b"))}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL["longest_whole_description"]).fetchall())


def test_retrieval_metrics_all(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)], i % 7) for i in range(1000)]
    rows[50] = (50, [0.0] * 4, 1)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        n = (dot(a, a) * dot(b, b)) ** 0.5
        return round(dot(a, b) / n, 9) if n else -2.0

    each = defaultdict(list)
    for i, v, label in rows[::50]:
        ranked = sorted((j for j, _, _ in rows if j != i), key=lambda j: (-cosine(v, rows[j][1]), j))[:10]
        hit = [k for k, j in enumerate(ranked, 1) if rows[j][2] == label]
        n = sum(x[2] == label for x in rows) - 1
        each[label].append((sum(k <= 3 for k in hit) / n, sum(k <= 5 for k in hit) / n, sum(1 / k for k in hit) / n))
    want = {k: (len(x), *[pytest.approx(sum(c) / len(x), abs=1e-8) for c in zip(*x)]) for k, x in each.items()}
    got = registry.QUERIES["retrieval_metrics_all"](spark, str(tmp_path)).collect()
    assert {x.label: tuple(x)[1:] for x in got} == want and sum(x.questions for x in got) == 20
