"""op6's tasks hold one shard of the index at a time."""

import weakref

import numpy as np
from corvane.llm import search


def test_a_shard_is_gone_before_the_next_is_loaded(monkeypatch):
    words = search.Hasher()
    parts = [search._terms(words, b"all w%d w%d" % (i % 5, i % 7)) for i in range(60)]
    rows = [search._row(a, list(range(a, a + 20)), parts[a : a + 20]) for a in range(0, 60, 20)]
    batches = [r.select(r.schema.names[1:]) for r in rows]
    load, made, alive = search.Shard.load, [], []

    def loaded(row, mean):
        alive.append(sum(m() is not None for m in made))
        shard = load(row, mean)
        made.append(weakref.ref(shard))
        return shard

    monkeypatch.setattr(search.Shard, "load", staticmethod(loaded))
    terms = parts[8][0]
    query = [7], np.array([0, len(terms)]), terms, np.arange(len(terms), dtype=np.int32), np.ones(len(terms)), np.zeros(1)
    scores, keys, known = search._best_of(iter(batches), query, 3.0, 2)[0]
    assert alive == [0, 0, 0] and keys.tolist() == [8, 31] and known.all()
    assert made[-1]() is None
