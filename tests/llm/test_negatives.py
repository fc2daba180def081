"""Hard negatives against brute force: nulls, ties, repeated rows, short vectors, small blocks, and blocks that meet without a broadcast."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<long>, row long, score string"


def rows():
    r = random.Random(7)
    centres = [[r.randrange(-60, 60) for _ in range(6)] for _ in range(5)]
    near = lambda c: [x + r.randrange(-25, 25) for x in c]
    found = [(i, r.randrange(4), near(r.choice(centres)), 0, "s") for i in range(400)]
    found += [(1000 + i, i % 3, [9, 9, 9, 9, 9, 9], 0, "s") for i in range(60)]  # one common vector
    found += [found[10], found[10], (50, 1, [9, 9, 9, 9, 9, 9], 0, "s"), (None, 2, near(centres[0]), 0, "s"), (None, 2, near(centres[0]), 0, "s")]
    return found + [(2000, None, [1] * 6, 0, None), (2050, 1, None, 0, None), (2100, 1, [1, None, 3, 4, 5, 6], 0, None), (2150, 1, [], 0, None), (2200, 2, [40, -3], 0, None), (2250, 9, [5] * 6, 0, "only of its label")]


def brute(table, every):
    part = [(i, lab, np.array(v + [0] * (6 - len(v)))) for i, lab, v, *_ in table if lab is not None and v is not None and None not in v]
    out = []
    for a, (anchor, label, q) in enumerate(part):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-int(q @ v), i is None, i or 0, b, i, lab) for b, (i, lab, v) in enumerate(part) if b != a), key=lambda x: x[:4])
        for p in [x for x in scored if x[5] == label][:5]:
            wanted = [x for x in scored if x[5] != label and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:3]
            out += [(anchor, p[4], k + 1, x[4], -p[0], -x[0]) for k, x in enumerate(wanted)]
    return out


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK_BYTES": 64 * 8 * 6, "BLOCK_ANCHORS": 3, "SENT_BYTES": 0, "CHUNK": 2, "SAMPLE": 40}.items():
            monkeypatch.setattr(negatives, name, value)
    table = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = negatives.mine(table, F.col("vec_id") % 10 == 0, "vec_id", "label", "embedding", sample=40 if small else 2048).collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows(), 10), key=key)
    assert len(found) > 100


def test_brackets_hold():
    r = np.random.default_rng(2)
    for scale in (1, 300, 1_000_000):
        v, q = r.integers(-scale, scale + 1, (200, 5)), r.integers(-scale, scale + 1, (40, 5))
        q[:20] = v[:20]
        space = negatives.Space(np.zeros((1, 6)), 5, float((v**2).sum(1).max()), v[:0, 0], v[:0, 0], v[:0])
        space.pivots = negatives.farthest_first(space.lifted(v), 6)
        low, high = negatives.brackets({"far": space.far(np.hstack([q, np.zeros((40, 1))])), "vector": q}, slice(0, 40), {"far": space.far(space.lifted(v))}, space.most)
        assert (low <= q @ v.T).all() and (q @ v.T <= high).all()


def test_products_beyond_floating_point():
    a = np.array([[1 << 30, 3, 1]])
    assert negatives.products(a, a).tolist() == [[(1 << 60) + 10]]


@pytest.mark.parametrize("table", [[], [(50, None, [1, 2], 0, "s")], [(50, 1, [1, 2], 0, "s")], [(50, 1, [], 0, "s"), (51, 1, [], 0, "s"), (52, 2, [], 0, "s")]])
def test_few_rows(spark, table):
    found = negatives.mine(spark.createDataFrame(table, SCHEMA), F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding")
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((50, 51, 1, 52, 0, 0),) if len(table) == 3 else ())
