"""near_dedup goes through op2's vantage-point tree: what it brings together is linked without any band."""

import random

from corvane.llm import shingles


def test_the_tree_links_what_shares_no_band(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    texts = [base, [*base[:-1], "other"], [f"v{r.randrange(10**6)}" for _ in range(3000)], ["x"], [], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {x.doc_id: (x.component_id, x.representative) for x in shingles.near_copies(docs, bands=0).collect()}
    assert found == {0: (0, True), 1: (0, False), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False)}


def test_fingerprint_of_a_set():
    a = shingles.shingles(b"a b c d e f g")
    assert shingles.set_fingerprint(a[:1]) == int(a[:1].view("<i8")[0]) and shingles.set_fingerprint(a[:0]) == 0
