"""Near copies against brute force over all pairs, and the pipeline's stage that uses them."""

import random

import corpus_pipeline
from corvane.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in (20, 60, 150, 400):
        for _ in range(12):
            base = [word() for _ in range(n)]
            for k in (0, 1, 2, 4, 8):
                copy = list(base)
                for i in r.sample(range(n), min(k, n)):
                    copy[i] = word()
                texts.append(" ".join(copy))
    hot = [word() for _ in range(200)]
    texts += [" ".join([*hot, *(word() for _ in range(r.randrange(6)))]) for _ in range(150)]  # one large group
    texts += texts[10:13]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[20], "en", "s", 0), (7, texts[7], "en", "s", 0)]


def components(found):
    def grams(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    sets, label = [grams(r[1]) for r in found], list(range(len(found)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if label[i] != label[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    ids = {}
    for k, r in zip(label, found):
        ids[k] = min((x for x in (ids.get(k), r[0]) if x is not None), default=None)
    return sorted((-1 if r[0] is None else r[0], ids[k]) for k, r in zip(label, found))


def test_near_copies_and_stage(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = components(rows())
    found = shingles.near_copies(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in found) == want
    assert sorted(r.component_id for r in found if r.representative) == sorted({k for _, k in want})
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({k for _, k in want})
    assert shingles.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks_never_exceed_the_difference():
    r, bits = random.Random(3), lambda m: sum((x & (1 << 64) - 1) << 64 * i for i, x in enumerate(m))
    for n in (0, 1, 5, 80, 700, 3000):
        ws = [f"w{r.randrange(900)}" for _ in range(n)]
        other = [w if r.random() < 0.9 else "x" + w for w in ws]
        a, b = (shingles.shingles(" ".join(x).encode()) for x in (ws, other))
        assert (bits(shingles.marks_of(a)) ^ bits(shingles.marks_of(b))).bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))


def templates(n, words=440, own=7, shared=True, seed=5):
    """Texts of one template with words of their own, in pairs that share some: 0.81 in a pair, 0.77 between pairs."""
    r = random.Random(seed)
    base, found = [f"t{i}" for i in range(words)], []
    gap = words // 12
    for pair in range(n // 2):
        both = list(base)
        for k in range(2 if shared else 0):
            both[gap * (k + 8) + 3] = f"p{pair}x{k}"
        for one in range(2):
            text = list(both)
            for k in range(own):
                text[gap * k + 3] = f"o{pair}x{one}x{k}"
            found.append(" ".join(text))
    return found


def test_templates(spark):
    texts = templates(400, own=9)
    a, b, c = (shingles.shingles(t.encode()) for t in (texts[0], texts[1], texts[2]))
    assert shingles.jaccard(a, b) >= 0.8 > shingles.jaccard(a, c) > 0.7
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    found = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    assert sum(found[i] == found[i + 1] == i for i in range(0, 400, 2)) >= 0.95 * 200 and len(set(found.values())) >= 200


def test_blocks_lose_nothing(spark, monkeypatch):
    """The same components where every family is cut into many blocks."""
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    monkeypatch.setattr(shingles, "BLOCK", 2000)
    found = shingles.near_copies(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in found) == components(rows())


def test_similar_pairs():
    import numpy as np

    r = np.random.default_rng(6)
    for _ in range(40):
        pool = r.integers(0, 1 << 60, 60).astype(np.uint64)
        bases = [r.choice(pool, r.integers(1, 50), replace=False) for _ in range(4)]
        sets = []
        for _ in range(60):
            s = list(bases[r.integers(4)])
            for _ in range(r.integers(0, 5)):
                s[r.integers(len(s))] = pool[r.integers(60)] if r.random() < 0.5 else r.integers(1 << 61, 1 << 62)
            sets.append(np.unique(np.array(s, np.uint64)))
        label, side = r.integers(0, 40, 60) if r.random() < 0.5 else np.arange(60), r.integers(0, 2, 60) if r.random() < 0.5 else np.zeros(60, int)

        def joined(pairs):
            at = label.copy()
            for a, b in pairs:
                at[at == at[a]] = at[b]
            return len(np.unique(at))

        two = len(np.unique(side)) > 1
        every = [(a, b) for a in range(60) for b in range(a) if (not two or side[a] != side[b]) and shingles.jaccard(sets[a], sets[b]) >= 0.8 - 1e-9]
        got = shingles.similar_pairs(sets, label, side, 0.8)
        assert all(shingles.jaccard(sets[a], sets[b]) >= 0.8 - 1e-9 for a, b in got)
        assert joined(got) == joined(every)
