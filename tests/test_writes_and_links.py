"""Writes of connections and link targets with nulls, repeats, empty tables and further columns."""

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import connections, policy, rollups


def test_written(spark):
    entries = spark.createDataFrame([("a", "x", "ok", 1), ("a", "y", "ok", 2), ("b", "x", "ok", 3), ("c", "x", None, 4)], "oid string, connection_id string, status string, __off int")
    writes = spark.createDataFrame([("a", "x", "invalid"), ("a", "x", "invalid"), ("a", "y", "disconnect"), ("a", "y", "invalid"), ("b", None, "forget"), ("z", "x", "invalid")], "oid string, connection_id string, action string")
    out = connections.written(entries.drop("__off"), writes)
    assert sorted(map(tuple, out.collect())) == [("a", "x", "invalid"), ("c", "x", None)]
    assert connections.written(entries.drop("__off"), writes.limit(0)).count() == 4
    assert connections.written(entries.limit(0).drop("__off"), writes).count() == 0


def test_resolved_target(spark):
    rows = [("a/b.md", "c.md"), ("a/b.md", "../c.md"), ("a/b.md", "../../c.md"), ("b.md", "/d/./e.md#f"), ("b.md", "mailto:x@y"), ("b.md", ""), ("b.md", None), (None, "c.md")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, r string").coalesce(1).select(text.resolved_target(F.col("p"), F.col("r"))).collect()]
    assert got == ["a/c.md", "c.md", None, "d/e.md", None, None, None, None]


def test_report_and_secrets_without_rows(spark):
    findings = spark.createDataFrame([], "review_id int, id int, severity string, title string, lenses array<string>, where string, detail string, suggestion string")
    out = rollups.report_sections(spark.createDataFrame([(1,)], "review_id int"), findings).collect()
    assert sorted(r.section for r in out) == ["## Blocker (0)\nNone.", "## Major (0)\nNone.", "## Nit (0)\nNone."]
    sources = spark.createDataFrame([("s", None, "n"), ("t", "k", "n"), ("t", "k", "n")], "source_id string, kind string, name string")
    assert [tuple(r) for r in policy.secret_references(sources).collect()] == [("k", "n", ["sources/t.yaml"])]
