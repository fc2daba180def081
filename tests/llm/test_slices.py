"""Slices bounded by bytes, and what an index of long texts holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import common, secrets


@pytest.mark.parametrize(("sizes", "rows", "most"), [([], 2, 10), ([0, 0, 0], 2, 10), ([50], 4, 10), ([3, 3, 3, 3, 3], 4, 10), ([10, 10, 1], 4, 10), ([1, 99, 1, None, 2], 4, 10)])
def test_cuts(sizes, rows, most):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array([None if n is None else "x" * n for n in sizes], pa.string())], names=["i", "t"])
    got = list(common.cuts(batch, [0, 1], rows, most))
    assert [at + k for at, n in got for k in range(n)] == list(range(len(sizes)))
    for at, n in got:
        size = sum(x or 0 for x in sizes[at : at + n])
        assert n <= rows and (size <= most or n == 1)
        after = at + n
        # No slice ends early.
        assert after == len(sizes) or n == rows or size + (sizes[after] or 0) > most


def test_index_of_pieces(monkeypatch):
    draw = np.random.default_rng(5)
    texts = [bytes(draw.integers(97, 100, n).astype(np.uint8)) for n in (0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 30, 200)]
    want = {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)}
    for piece in (1, 2, 10, 50, 1 << 20):
        monkeypatch.setattr(secrets, "PIECE_BYTES", piece)
        index = secrets.Index(texts)
        grams = {g for g, _ in want}
        assert {(g, i) for g in grams for i in index.postings(g.decode()).tolist()} == want
        assert len(index.keys) == len(want)
    assert len(secrets.Index([]).keys) == len(secrets.Index([b"", b"ab"]).keys) == 0


def test_index_of_long_texts_is_bounded():
    """64 texts of 1 MB, 4 MB at a time as a task sees them: below 250 MB; all at once they took 33 bytes for each of theirs."""
    words = [b"word%d " % i for i in range(5000)]
    draw = np.random.default_rng(1)
    texts = [b"".join(words[k] for k in draw.integers(0, 5000, 120_000))[: 1 << 20] for _ in range(16)]
    tracemalloc.start()
    for at in range(0, 64, 4):
        secrets.Index([texts[(at + k) % 16] for k in range(4)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20


def test_secret_in_a_long_text():
    search = secrets.searcher()
    text = "a b " * 400_000 + "AKIA" + "B" * 16 + " c d" * 400_000
    assert search([text, None, ""]) == [[[("access", 1_600_000, 1_600_020)], [], []]]
