"""Cutting texts for fill-in-the-middle against a plain version, and units of other grammars."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import infill

TEXTS = [None, "", "ab cd", "😀a😀b😀😀c", "a<P>b", "<S", "<M>", "\n\nabc\n", "x" * 1000, "éé", "AbC9d\x00\x7f", "a_b" * 300, "<" * 40 + "P>", "word 12.5 ü\r\n" * 2000]


def plain(key, text):
    t = text or ""
    us = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(us) + 1), h[1] % (len(us) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(us), "plain", t, None, None
    p, m, s = ("".join(x) for x in (us[:low], us[low:high], us[high:]))
    return (len(us), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < 20 else (len(us), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_against_plain(spark):
    rows = [(i, t, "kept", "taken") for i in [*range(60), None, -3] for t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Units string, form string").repartition(3)
    found = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.Units == "kept"


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("grammar", "pattern"), [(infill.WORDS, r"[A-Za-z]+|[^A-Za-z]"), (infill.CHARACTERS, r"(?s)."), (infill.LINES, r"[^\n]*\n|[^\n]+"), ((("0-9", "run"), ("^0-9", "run")), r"[0-9]+|[^0-9]+")])
def test_units(spark, grammar, pattern):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", infill.units(F.col("t"), grammar).alias("u"))
    for r in docs.collect():
        assert r.u == re.findall(pattern, r.t or ""), r.t


def test_unknown_kind():
    with pytest.raises(ValueError):
        infill.boundary((("a", "twice"),))
