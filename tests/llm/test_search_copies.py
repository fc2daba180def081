"""op6 indexes and searches each text once, whatever its copies, and finds the same as without that."""

from collections import Counter

import numpy as np
from corvane.llm import search


def test_copies_are_indexed_and_searched_once(spark):
    texts = [(i, f"all W{i % 7} w{i % 3}") for i in range(40)] + [(99, None), (98, ""), (None, "all w1 W1")]
    rows = [(k if k is None or not c else k + 1000 * c, t) for c in range(5) for k, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = search.build(docs)
    assert index.n == len(rows) and index.shards.agg({"n": "sum"}).first()[0] == len({t or "" for _, t in rows})
    assert {r.df for r in index.frequencies.collect()} == {n for n in Counter(w for _, t in rows for w in set((t or "").lower().split())).values()}
    queries = docs.where("doc_id % 10 = 0 OR doc_id IS NULL")
    assert search.weigh(queries, index, "doc_id", "text")[0].count() < queries.select("text").distinct().count() + 1 < queries.count()
    got = {}
    for r in search.top_k(docs, queries, k=6, index=index).collect():
        got.setdefault((r.query, r.query_id), []).append((r.rank, r.doc_id))
    assert Counter(q for _, q in got) == Counter(k for k, t in rows if t and (k is None or k % 10 == 0))
    words = {k: sorted((t or "").lower().split()) for k, t in rows if k is not None}
    for (_, q), found in got.items():
        same = sorted(k for k, w in words.items() if w == words.get(q, ["all", "w1", "w1"]))[:6]
        assert [k for _, k in sorted(found)][: len(same)] == same


def test_queries_together_find_what_each_finds_alone():
    r = np.random.default_rng(5)
    words = search.Hasher()
    parts = [search._terms(words, " ".join(f"w{x}" for x in np.minimum(r.zipf(1.2, int(r.integers(1, 90))), 800)).encode()) for _ in range(700)]
    shard = search.Shard.load(search._row(0, list(range(2100)), parts, [3] * 700).to_pylist()[0], float(np.mean([p[2] for p in parts])))
    asked = [(shard.places(h), r.random(len(h))) for h, _, _ in parts[::9]] + [(np.full(2, -1), np.ones(2)), (np.zeros(0, int), np.zeros(0))]
    alone = [shard.search(at, w, 5, search.NONE) for at, w in asked]
    for least in (np.zeros(len(asked)), [x[0][-1] - search.SAME if len(x[0]) else 0.0 for x in alone]):
        got = shard.search_all(asked, 5, [search.NONE] * len(asked), least)
        assert [x[1].tolist() for x in got] == [x[1].tolist() for x in alone]
    assert len(got[0][1]) == 5 and len(got[-1][1]) == len(got[-2][1]) == 0


def test_a_task_has_one_thread_for_products(spark):
    def threads(batches):
        import ctypes
        import re

        import pandas as pd
        from corvane.llm.common import one_thread

        one_thread()
        found = [getattr(ctypes.CDLL(p), n) for p in set(re.findall(r"(/\S*openblas\S*)", open("/proc/self/maps").read())) for n in ("scipy_openblas_get_num_threads64_", "openblas_get_num_threads64_", "openblas_get_num_threads") if hasattr(ctypes.CDLL(p), n)]
        for _ in batches:
            yield pd.DataFrame({"n": [f() for f in found]})

    assert {r.n for r in spark.range(1).mapInPandas(threads, "n int").collect()} <= {1}
