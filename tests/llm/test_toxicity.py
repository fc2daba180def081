"""Toxic passages: segments against brute force, the fit of extreme values, held-out accuracy on made-up texts, and the defined results."""

import random
import zlib

import numpy as np
import pytest

from corvane.llm import toxicity

LABELS = "doc_id long, toxic int, quality int"
SCHEMA = "doc_id long, text string, Score double, label int"
BAD = ["idiot", "scum", "moron", "trash"]
STEMS = ["zulko", "brak"]
ENDS = ["en", "lich", "ung", "ei", "schaft", "tum", "ler", "isch"]
held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


def all_maximal(scores):
    """By definition: the best segment (the shortest of equals), then those of what lies on either side."""
    best, at = 0, None
    for a in range(len(scores)):
        for z in range(a, len(scores)):
            s = sum(scores[a : z + 1])
            if s > best or at and s == best and z - a < at[1] - at[0]:
                best, at = s, (a, z)
    if at is None:
        return []
    return [*all_maximal_at(scores[: at[0]], 0), (*at, best), *all_maximal_at(scores[at[1] + 1 :], at[1] + 1)]


def all_maximal_at(scores, by):
    return [(a + by, z + by, s) for a, z, s in all_maximal(scores)]


def test_segments():
    r = random.Random(1)
    for _ in range(400):
        scores = [r.choice([-3, -2, -1, -1, 1, 2, 4, 0.5]) + r.random() / 1000 for _ in range(r.randrange(14))]
        got = toxicity.segments(enumerate(scores))
        want = all_maximal(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want], scores
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_segments_in_linear_time():
    looked = 0

    def many():
        nonlocal looked
        for i in range(300_000):
            looked += 1
            yield i, (1.0 if i % 2 else -1.5)

    assert len(toxicity.segments(many())) == 150_000 and looked == 300_000


def test_extreme_values():
    r = np.random.default_rng(4)
    lengths = r.integers(20, 3000, 6000).astype(float)
    best = np.maximum(0, (np.log(0.02 * lengths) - np.log(-np.log(r.random(6000)))) / 1.4)
    k, rate = toxicity.extreme_values(lengths, best)
    assert abs(rate - 1.4) < 0.1 and abs(np.log(k / 0.02)) < 0.2
    model = toxicity.Model({}, k=k, rate=rate)
    # One in a hundred clean texts is beyond the level of one in a hundred.
    assert 0.005 < np.mean([model.log_p(n, s) < np.log(0.01) for n, s in zip(lengths, best)]) < 0.02


def test_forms_weigh_what_their_stem_does():
    w = toxicity.weights([("zul", 1, 60), ("zulk", 0, 60), ("zulko", 0, 60), ("zulkoen.", 0, 30), ("the.", 900, 90), ("and", 500, 50), ("andere.", 6, 0)], (1000, 100))
    m = toxicity.Model(w)
    assert m.of("zulkoneverseen") == w["zulko"] > 2 and m.of("zulkoen") > 4 and abs(m.of("the")) < 0.2 and m.of("nothing") == 0 and m.of("andere") < -0.5


def made(n, seed=0):
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "in"] + ["".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws, toxic = [r.choice(common) for _ in range(r.randrange(8, 200))], r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(2, 6)):
                ws.insert(r.randrange(len(ws)), r.choice(BAD) if r.random() < 0.5 else r.choice(STEMS) + r.choice(ENDS))
        docs.append((i, " ".join(ws) + ".", 0.5, 1))
        labels.append((i, int(toxic), 0))
    return docs, labels


def test_held_out(spark):
    docs, labels = made(1500)
    docs += [(9000, None, 0.0, None), (9001, "", 0.0, None), (9002, "12 34 !!", 0.0, None), (None, "you idiot, you scum", 0.0, None), docs[3], (9003, "SCUM! Idiot; " + "the of " * 20_000 + "İ moron trash", 0.0, 1), (9004, "lamnot " * 5000, 0.0, 1)]
    known = dict((i, t) for i, t, _ in labels)
    given = labels + [(5, None, 1), (6, 7, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    found = toxicity.assess(frame, spark.createDataFrame(given, LABELS)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    tested = [r for r in found if r.doc_id in known and held(r.doc_id)]
    assert len(tested) > 200 and all(r.held_out for r in tested)
    assert sum(r.predicted == known[r.doc_id] for r in tested) >= 0.98 * len(tested)
    by = {r.doc_id: r for r in found}
    assert by[9000].score == by[9001].score == by[9002].score < 0.5 and not by[9000].passages
    assert by[None].predicted == 1 and not by[None].held_out and by[9004].predicted == 0
    text = by[9003].text
    assert by[9003].predicted == 1 and [text[p.start : p.end] for p in by[9003].passages] == ["SCUM! Idiot", "moron trash"]


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = made(600, 1)
    frame, turned = spark.createDataFrame(docs, SCHEMA), [(i, 1 - t if held(i) else t, q) for i, t, q in labels]
    score = lambda given: sorted((r.doc_id, r.score) for r in toxicity.assess(frame, spark.createDataFrame(given, LABELS)).collect())
    assert score(labels) == score(turned)


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 0, 0), (2, 0, 0)], 0.0), ([(1, 1, 0)], 1.0)])
def test_labels_of_one_class(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b c", 0.0, 1), (2, None, 0.0, 1)], SCHEMA)
    assert {r.score for r in toxicity.assess(docs, spark.createDataFrame(labels, LABELS)).collect()} == {score}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.assess(none, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)).count() == 0


def test_bounds(spark):
    docs, labels = made(800, 2)
    frame, given = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(frame, given, bound=60, terms=150)
    assert 0 < len(model.weight) <= 150
