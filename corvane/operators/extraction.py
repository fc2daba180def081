"""Extraction of entities and relations: what the cache has is taken from there, each other text is asked for once, and failures hold back their documents.

The extractor is a function from a text to a JSON object {entities: [{name, type, description}], relations: [{source, relation, target}]}. An answer of another form is
a failure, as is an error that the function raises; failures aren't stored, so that the next run asks again. What is answered is written before it
goes into the cache: a lost executor costs the answers of its own running tasks.

Defined results: a null text is asked for as an empty one; chunks with one text are asked for once, however many there are; a document without chunks has no row;
null lists in an answer are empty; rows of the cache with one key are answers to one text, of which the least counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .graph import cache_key

ANSWER = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,relation:string,target:string>>"
FIELDS = {"entities": ("name", "type", "description"), "relations": ("source", "relation", "target")}
CACHE = "cache_key string, result string"
#: Texts that a task holds at once.
ROWS = 64


def answered(raw: str) -> str:
    """The answer as JSON with the fields of ANSWER and no others; an error if it has another form."""
    read = json.loads(raw)
    if not isinstance(read, dict):
        raise ValueError("not an object")
    kept = {}
    for name, fields in FIELDS.items():
        rows = read.get(name) or []
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValueError(f"{name} isn't a list of objects")
        if not all(isinstance(r.get(f), str | None) for r in rows for f in fields):
            raise ValueError(f"{name} have values that aren't texts")
        kept[name] = [{f: r.get(f) for f in fields} for r in rows]
    return json.dumps(kept, ensure_ascii=False)


def asked(misses: DataFrame, ask: Callable[[str], str], at_once: int) -> DataFrame:
    """(cache_key, result, error) of (cache_key, content), each task asking for `at_once` texts at a time."""

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            return answered(ask(text or "")), None
        except Exception as e:  # whatever the extractor raises is that text's failure
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    got = list(pool.map(one, b.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in zip(*got)]], names=["cache_key", "result", "error"])

    return misses.select("cache_key", "content").mapInArrow(run, "cache_key string, result string, error string")


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """(cache_key, result) of what is stored, one row a key; nothing if there is no cache yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(root).groupBy("cache_key").agg(F.min("result").alias("result"))


@dataclass(frozen=True)
class Extracted:
    """found: (source_id, path, chunk_id, entities, relations) of whole documents; failed: (source_id, path, n_failed, error) of the others; asked: texts
    that the extractor was asked for."""

    found: DataFrame
    failed: DataFrame
    asked: int


def extract(chunks: DataFrame, cache: str, ask: Callable[[str], str], version: str, model: str, types: list[str], relations: list[str], at_once: int = 4, tasks: int | None = None) -> Extracted:
    """Extractions of chunks (source_id, path, chunk_id, content), `at_once` times `tasks` texts being asked for at a time; answers go to the folder `cache`."""
    spark = chunks.sparkSession
    keyed = materialize(chunks.select("source_id", "path", "chunk_id", "content").withColumn("cache_key", cache_key(version, model, types, relations, F.col("content"))), "keyed")
    known = read_cache(spark, cache)
    misses = keyed.groupBy("cache_key").agg(F.min("content").alias("content")).join(known, "cache_key", "left_anti")
    answers = materialize(asked(misses.repartition(tasks or spark.sparkContext.defaultParallelism), ask, at_once), "answers")
    # What the cache had for these chunks is kept apart from it, since it grows below.
    wanted = keyed.select("cache_key").distinct()
    had = materialize(known.join(wanted, "cache_key", "left_semi"), "had")
    good = answers.where("error IS NULL").select("cache_key", "result")
    good.write.mode("append").parquet(cache)
    outcome = had.withColumn("error", F.lit(None).cast("string")).unionByName(answers)
    each = keyed.join(outcome, "cache_key", "left")
    failed = each.where("error IS NOT NULL").groupBy("source_id", "path").agg(F.count("*").alias("n_failed"), F.min(F.struct("chunk_id", "error"))["error"].alias("error"))
    failed = materialize(failed, "failed")
    same = each["source_id"].eqNullSafe(failed["source_id"]) & each["path"].eqNullSafe(failed["path"])
    whole = each.join(failed, same, "left_anti")
    found = whole.withColumn("a", F.from_json("result", ANSWER)).select("source_id", "path", "chunk_id", "a.entities", "a.relations")
    return Extracted(found, failed, answers.count())


def entity_rows(found: DataFrame) -> DataFrame:
    """(doc, pos, name, type, description), the form that graph.clean_extraction takes; doc is the chunk."""
    return found.select(F.col("chunk_id").alias("doc"), F.posexplode("entities").alias("pos", "e")).select("doc", "pos", "e.*")


class Vocabulary:
    """An extractor without a model: names of a small vocabulary that stand in the text as words of their own, in the order of their first places."""

    def __init__(self, names: dict[str, str]):
        self.names = dict(names)

    def __call__(self, text: str) -> str:
        import re

        lower = text.lower()
        first = {n: m.start() for n in self.names if (m := re.search(rf"(?<![a-z0-9_-]){re.escape(n.lower())}(?![a-z0-9_-])", lower))}
        return json.dumps({"entities": [{"name": n, "type": self.names[n], "description": ""} for n in sorted(first, key=lambda n: (first[n], n))], "relations": []})
