"""Batches of listed items become states of the store: repeated, failed, stopped half-way, forced, dry, and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import store
from corvane.streaming import ingest

COLUMNS = [c.split()[0] for c in ingest.FOUND.split(", ")]


def batch(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], ingest.FOUND)


def item(source, path, text, **more):
    return {"source_id": source, "kind": "item", "path": path, "content_hash": f"h{text}", "text": text, "title": "t", **more}


def note(source, kind, path=None, cursor=None):
    return {"source_id": source, "kind": kind, "path": path, "cursor": cursor}


def held(spark, root):
    documents = store.read(spark, root, store.DOCUMENTS, ingest.SCHEMAS[store.DOCUMENTS])
    chunks = store.read(spark, root, store.CHUNKS, ingest.SCHEMAS[store.CHUNKS])
    rows = documents.join(chunks.select("document_id", "content"), "document_id", "left").select("source_id", "path", "title", "content")
    return sorted(tuple(r) for r in rows.collect())


def counts(df):
    return {r.source_id: (r.changed, r.metadata, r.unchanged, r.restricted, r.deleted) for r in df.collect()}


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = batch(spark, item("a", "x.md", "one"), item("a", "y.md", "two"), item("b", "x.md", "three"), item("a", "n", None), note("a", "end", cursor="1"), note("b", "end", cursor="1"))
    assert counts(ingest.apply(spark, root, first, "s", 0)) == {"a": (3, 0, 0, 0, 0), "b": (1, 0, 0, 0, 0)}
    return root


FIRST = [("a", "n", "t", None), ("a", "x.md", "t", "one"), ("a", "y.md", "t", "two"), ("b", "x.md", "t", "three")]


def test_repeated_batch_changes_nothing(spark, root):
    assert held(spark, root) == FIRST
    states = store.finished(spark, root)
    assert ingest.apply(spark, root, batch(spark, item("a", "x.md", "other")), "s", 0) is None
    assert held(spark, root) == FIRST and store.finished(spark, root) == states
    # Another stream has batches of its own.
    assert counts(ingest.apply(spark, root, batch(spark, item("a", "x.md", "other")), "s2", 0))["a"] == (1, 0, 3 - 1, 0, 0)


def test_deletes_only_after_a_whole_listing(spark, root):
    changed = batch(spark, item("a", "x.md", "new"), item("b", "z.md", "four"), note("b", "error"))
    assert counts(ingest.apply(spark, root, changed, "s", 1)) == {"a": (1, 0, 2, 0, 0)}
    assert held(spark, root) == [FIRST[0], ("a", "x.md", "t", "new"), FIRST[2], FIRST[3]]
    assert (ingest.cursor_of(spark, root, "a"), ingest.cursor_of(spark, root, "b")) == ("1", "1")
    whole = batch(spark, item("a", "y.md", "two", title="now"), note("a", "listed", "n"), note("a", "end", cursor="2"), note("b", "end"))
    assert counts(ingest.apply(spark, root, whole, "s", 2)) == {"a": (0, 1, 1, 0, 1), "b": (0, 0, 0, 0, 1)}
    assert held(spark, root) == [FIRST[0], ("a", "y.md", "now", "two")]
    assert (ingest.cursor_of(spark, root, "a"), ingest.cursor_of(spark, root, "b")) == ("2", None)


def test_restricted_forced_dry_and_odd_rows(spark, root):
    odd = batch(spark, item("a", "x.md", "one", restricted=True), item("a", "q.md", "secret", restricted=True), item("a", None, "lost"), item(None, "p", "lost"), {"source_id": "a", "kind": "what"}, item("b", "x.md", "three"), item("b", "x.md", "three"))
    assert counts(ingest.apply(spark, root, odd, "s", 0, dry_run=True)) == {"a": (0, 0, 2, 2, 1), "b": (0, 0, 1, 0, 0)}
    assert held(spark, root) == FIRST
    ingest.apply(spark, root, odd, "s", 1)
    assert held(spark, root) == [FIRST[0], FIRST[2], FIRST[3]]
    assert counts(ingest.apply(spark, root, batch(spark, item("b", "x.md", "three")), "s", 2, force=True)) == {"b": (1, 0, 0, 0, 0)}
    assert ingest.apply(spark, root, batch(spark), "s", 3).count() == 0 and held(spark, root) == [FIRST[0], FIRST[2], FIRST[3]]


def test_stopped_half_way(spark, root, monkeypatch):
    late = batch(spark, item("a", "x.md", "new"), note("b", "end", cursor="2"))
    real = store.commit

    def stops(spark, root, tables, sources, new_marks=None):
        for name, rows in tables.items():
            rows.withColumn("folder", F.sha2("source_id", 256)).write.partitionBy("folder").parquet(f"{root}/{name}/stopped")
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "commit", stops)
    with pytest.raises(RuntimeError):
        ingest.apply(spark, root, late, "s", 1)
    assert held(spark, root) == FIRST and ingest.cursor_of(spark, root, "b") == "1"
    monkeypatch.setattr(store, "commit", real)
    ingest.apply(spark, root, late, "s", 1)
    assert held(spark, root) == [FIRST[0], ("a", "x.md", "t", "new"), FIRST[2]] and ingest.cursor_of(spark, root, "b") == "2"


def test_as_a_stream(spark, tmp_path):
    root, folder = f"file://{tmp_path}/store", tmp_path / "found"
    folder.mkdir()

    def run(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        found = spark.readStream.schema(ingest.FOUND).json(str(folder))
        ingest.writer(found, root, "files", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(90)

    run("1.json", item("a", "x.md", "one"), item("a", "y.md", "two"), note("a", "end", cursor="1"))
    run("2.json", item("a", "y.md", "three"), note("a", "end", cursor="2"))
    assert held(spark, root) == [("a", "y.md", "t", "three")]
    assert store.marks(spark, root) == {"batch files": "1", "cursor a": "2"}
