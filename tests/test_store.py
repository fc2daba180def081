"""Writes of five dependent tables as one: cascades, orphans, stops half-way, writers that meet, other sources untouched."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import store

SCHEMAS = {
    "documents": "document_id long, source_id string, path string, classification_rank int",
    "chunks": "chunk_id long, document_id long, source_id string, classification_rank int, content string",
    "entities": "entity_id long, source_id string, classification_rank int, key string",
    "mentions": "entity_id long, chunk_id long, source_id string, classification_rank int",
    "edges": "src_id long, dst_id long, relation string, chunk_id long, source_id string, classification_rank int",
}


def frames(spark, documents, chunks=(), entities=(), mentions=(), edges=()):
    rows = dict(documents=documents, chunks=chunks, entities=entities, mentions=mentions, edges=edges)
    return {t: spark.createDataFrame(list(v), SCHEMAS[t]) for t, v in rows.items()}


def paths(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_id string, path string")


def ids(spark, root, table, column, **which):
    return sorted(r[0] for r in store.read(spark, root, table, SCHEMAS[table], **which).select(column).collect())


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = frames(
        spark,
        [(1, "a", "x.md", 0), (2, "a", "y.md", 0), (3, "b/ü=1", "x.md", 1)],
        [(10, 1, "a", 0, "p"), (11, 1, "a", 0, "q"), (20, 2, "a", 0, "r"), (30, 3, "b/ü=1", 1, "s")],
        [(100, "a", 0, "k"), (101, "a", 0, "l"), (102, "a", 0, "m"), (300, "b/ü=1", 1, "k")],
        [(100, 10, "a", 0), (101, 11, "a", 0), (101, 20, "a", 0), (102, 20, "a", 0), (300, 30, "b/ü=1", 1)],
        [(100, 101, "r", 11, "a", 0), (101, 102, "r", 20, "a", 0), (100, 101, "r", 20, "a", 0)],
    )
    assert store.replace_documents(spark, root, SCHEMAS, paths(spark), one) == 1
    return root


def test_replace_and_delete(spark, root):
    before = {r.source_id: r.folder for r in store.manifest(spark, root).where("table = 'documents'").collect()}
    new = frames(spark, [(4, "a", "x.md", 0)], [(40, 4, "a", 0, "n")], [(103, "a", 0, "n")], [(103, 40, "a", 0)])
    assert store.replace_documents(spark, root, SCHEMAS, paths(spark, ("a", "x.md")), new) == 2
    assert ids(spark, root, "documents", "document_id") == [2, 3, 4] and ids(spark, root, "chunks", "chunk_id") == [20, 30, 40]
    # 100 has no mention any more, and so its edges go, though their evidence stays.
    assert ids(spark, root, "entities", "entity_id") == [101, 102, 103, 300] and ids(spark, root, "edges", "src_id") == [101]
    after = {r.source_id: r.folder for r in store.manifest(spark, root).where("table = 'documents'").collect()}
    assert after["b/ü=1"] == before["b/ü=1"] and after["a"] != before["a"]
    assert ids(spark, root, "documents", "document_id", sources=["b/ü=1"]) == [3] and ids(spark, root, "documents", "document_id", state=1) == [1, 2, 3]
    assert store.replace_documents(spark, root, SCHEMAS, paths(spark, ("a", "x.md"), ("a", "y.md"), ("a", "none"), ("nowhere", "z"))) == 3
    assert {t: ids(spark, root, t, "source_id") for t in SCHEMAS} == {t: [] if t == "edges" else ["b/ü=1"] for t in SCHEMAS}


def test_a_write_that_stops_half_way(spark, root, monkeypatch):
    class Stop(Exception):
        pass

    begun = []

    def stop(tables):
        tables = whole(tables)
        fails = F.udf(lambda x: 1 / 0, "long")
        begun.append(True)
        return tables | {"edges": tables["mentions"].select(fails("entity_id").alias("src_id"), F.lit(1).cast("long").alias("dst_id"), F.lit("r").alias("relation"), "chunk_id", "source_id", "classification_rank")}

    whole = store.without_orphans
    monkeypatch.setattr(store, "without_orphans", stop)
    with pytest.raises(Exception, match="division by zero"):
        store.replace_documents(spark, root, SCHEMAS, paths(spark, ("a", "x.md")))
    monkeypatch.undo()
    assert begun and store.finished(spark, root) == [1] and ids(spark, root, "documents", "document_id") == [1, 2, 3] and len(ids(spark, root, "edges", "src_id")) == 3
    assert store.replace_documents(spark, root, SCHEMAS, paths(spark, ("a", "x.md"))) == 2 and ids(spark, root, "documents", "document_id") == [2, 3]


def test_two_writes_from_one_state(spark, root, monkeypatch):
    monkeypatch.setattr(store, "finished", lambda *_: [1])
    assert store.replace_documents(spark, root, SCHEMAS, paths(spark, ("a", "x.md"))) == 2
    with pytest.raises(Exception, match="already exists"):
        store.replace_documents(spark, root, SCHEMAS, paths(spark, ("a", "y.md")))
    monkeypatch.undo()
    assert ids(spark, root, "documents", "document_id") == [2, 3]


def test_sources(spark, root):
    ranks = spark.createDataFrame([("a", 2)], "source_id string, new_rank int")
    assert store.sync_sources(spark, root, SCHEMAS, ranks) == 2
    for t in SCHEMAS:
        assert {(r.source_id, r.classification_rank) for r in store.read(spark, root, t, SCHEMAS[t]).collect()} == {("a", 2)}, t
    kept = {r.folder for r in store.manifest(spark, root).collect()}
    assert store.sync_sources(spark, root, SCHEMAS, ranks) == 3 and {r.folder for r in store.manifest(spark, root).collect()} == kept


def test_rows_of_other_sources_and_unknown_states(spark, root):
    with pytest.raises(ValueError, match="aren't among"):
        store.commit(spark, root, {"documents": spark.createDataFrame([(9, "c", "p", 0)], SCHEMAS["documents"])}, spark.createDataFrame([("a",)], "source_id string"))
    with pytest.raises(ValueError, match="no state 7"):
        store.manifest(spark, root, 7)
    assert ids(spark, root, "documents", "document_id") == [1, 2, 3]
