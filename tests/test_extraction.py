"""Cache misses are asked for once, failures are held back and asked for again; the whole graph answer's guards."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import extraction, graph

ROWS = [("a", "x", 1, "alpha and beta"), ("a", "x", 2, "fails"), ("a", "y", 3, "beta"), ("b", "x", 4, "beta"), ("b", None, 5, None), ("b", None, 6, "")]


def asking(log):
    def ask(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "fails":
            raise TimeoutError("too slow")
        return extraction.Vocabulary({"alpha": "letter", "beta": "letter"})(text)

    return ask


def test_misses_failures_and_the_cache(spark, tmp_path):
    chunks = spark.createDataFrame(ROWS, "source_id string, path string, chunk_id int, content string")
    log, cache = str(tmp_path / "log"), f"file://{tmp_path}/cache"
    run = lambda c, **more: extraction.extract(c, cache, asking(log), "1", "m", ["letter"], [], **more)
    one = run(chunks)
    assert sorted(open(log).read().split("\n")[:-1]) == ["", "alpha and beta", "beta", "fails"] and one.asked == 4
    assert {(r.chunk_id, tuple(e.name for e in r.entities)) for r in one.found.collect()} == {(3, ("beta",)), (4, ("beta",)), (5, ()), (6, ())}
    assert [tuple(r) for r in one.failed.collect()] == [("a", "x", 1, "TimeoutError: too slow")]
    two = run(chunks)
    assert two.asked == 1 and two.found.count() == 4 and open(log).read().split("\n")[4:] == ["fails", ""]
    assert sorted(r.cache_key for r in spark.read.parquet(cache).collect()) == sorted(set(r.cache_key for r in spark.read.parquet(cache).collect()))
    assert run(chunks.limit(0)).found.count() == 0
    other = extraction.extract(chunks, cache, asking(log), "2", "m", ["letter"], [])
    assert other.asked == 4
    cleaned = graph.clean_extraction(extraction.entity_rows(one.found), ["letter"]).collect()
    assert {(r.doc, r.name) for r in cleaned} == {(3, "beta"), (4, "beta")}


@pytest.mark.parametrize("raw", ["", "no", "[]", '{"entities": 1}', '{"entities": ["x"]}', '{"relations": [{"source": 1}]}'])
def test_answers_of_another_form(raw):
    with pytest.raises(ValueError):
        extraction.answered(raw)


def test_answers_are_read_back(spark):
    raw = '{"entities": [{"name": "\\u00fc\\"", "type": "t", "more": 1}], "relations": null, "other": 2}'
    kept = extraction.answered(raw)
    assert json.loads(kept) == {"entities": [{"name": 'ü"', "type": "t", "description": None}], "relations": []}
    row = spark.createDataFrame([(kept,)], "r string").select(F.from_json("r", extraction.ANSWER).alias("a")).first().a
    assert [tuple(e) for e in row.entities] == [('ü"', "t", None)] and row.relations == []


def test_whole_answer(spark):
    chunks = spark.createDataFrame([(1, "s", "d", "red kite", None, [1.0, 0.0]), (2, "s", "d", "kite", None, [0.9, 0.1]), (3, "t", "e", "fox", None, [0.0, 1.0])], "chunk_id int, source_id string, path string, content string, heading string, embedding array<float>")
    entities = spark.createDataFrame([(i, n, n.lower(), s, "animal", None) for i, (n, s) in enumerate([("Kite", "s"), ("Kite", "t"), ("Fox", "s"), ("Fox", "t")])], "entity_id int, name string, key string, source_id string, type string, description string")
    mentions = spark.createDataFrame([(0, 1), (2, 3)], "entity_id int, chunk_id int")
    edges = spark.createDataFrame([(0, "eats", 2, "s"), (1, "eats", 3, "t"), (0, "eats", 2, "s")], "src_id int, relation string, dst_id int, source_id string")
    ask = lambda q, k=5: graph.answer(chunks, entities, mentions, edges, [1.0, 0.0], [], q, k, 1).first()
    got = ask("kite?")
    assert [(r.path, r.via, r.score) for r in got.results] == [("d", "graph", 1.06), ("e", "graph", 0.06)]
    assert got.seeds == ["fox", "kite"] and [(e.name, e.source, e.hops) for e in got.entities] == [("Fox", "s", 0), ("Fox", "t", 0), ("Kite", "s", 0), ("Kite", "t", 0)]
    assert [tuple(r) for r in got.relations] == [("Kite", "eats", "Fox", "s"), ("Kite", "eats", "Fox", "t")]
    assert [len(x) for x in ask(" ")] == [0, 0, 0, 0] and len(ask("kite", -3).results) == 1
