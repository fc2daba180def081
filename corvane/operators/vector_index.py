"""A stored vector index under the row policy: lists of vectors by their nearest centroid, of which a search opens the nearest ones.

The centroids are fitted to a bounded sample (`SAMPLE` rows, drawn by hash); every row is indexed. A list is a folder, so that unopened lists aren't read, and its rows
carry what the policy needs. With the lists stands how many rows of each source and rank they hold: a search opens its `probes` nearest lists, and goes on
until those hold k rows that the policy lets through (or there are no more lists). How many are to be opened for a wanted recall depends on the vectors and on the
policy; `opened_for` measures it on some of the searches, exactly. Rows are filtered before they are ranked, and ranked by their exact cosine, ties by key.

A list is worked on in parts of about `PART` rows, each with at most about `ASKING` searches at once, so that a list with very many equal vectors is no
one task's. A null vector isn't indexed, and finds nothing; a zero vector has similarity 0; vectors of another length than the index are an error; an empty table gives an
empty index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .scope import scoped

SAMPLE, MOST_LISTS = 16_384, 1024
#: Rows of a list that are compared at once, and searches that they are compared with.
PART, ASKING = 16_384, 1024
#: Share of the lists that a search opens at first, where it isn't measured.
OPENED = 0.25
#: Searches that are answered from all lists to measure it, and the recall wanted.
TRIED, RECALL = 64, 0.95
STEPS, SEED = 12, 3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Unit vectors in doubles of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(np.asarray(column.value_lengths()))
    if len(sizes) > 1 or dim is not None and len(sizes) and sizes[0] != dim:
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()) | ({dim} if dim else set()))} numbers: all are to have as many")
    return unit(np.nan_to_num(np.asarray(column.flatten().cast(pa.float64()))).reshape(len(column), -1))


def centroids_of(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means: far-apart starts by a seeded draw, some rounds, an empty list taking the vector that fits its own worst."""
    r = np.random.default_rng(SEED)
    at = vectors[r.choice(len(vectors), min(lists, len(vectors)), replace=False)]
    for _ in range(STEPS):
        fit = vectors @ at.T
        own = fit.argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, vectors)
        lost = np.flatnonzero(np.bincount(own, minlength=len(at)) == 0)
        sums[lost] = vectors[np.argsort(fit.max(1), kind="stable")[: len(lost)]]
        at = unit(sums)
    return at


def write_index(chunks: DataFrame, folder: str | None = None, key: str = "chunk_id", vector: str = "embedding", lists: int | None = None) -> str:
    """Write the index of `chunks` (a whole-number key, vector, source_id, classification_rank) and return its folder. `lists`: the square root of the rows, MOST_LISTS at most."""
    spark = chunks.sparkSession
    folder = folder or scratch(spark, "vector-index") + "/index"
    own = chunks.where(F.col(f"`{vector}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("key"), "source_id", "classification_rank", F.col(f"`{vector}`").cast("array<float>").alias("vector"))
    n = own.count()
    drawn = own.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toArrow()
    at = centroids_of(matrix(drawn.column("vector")), lists or max(1, min(MOST_LISTS, round(n**0.5)))) if len(drawn) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(at)

    def assign(batches):
        for b in batches:
            near = (matrix(b.column("vector"), shared.value.shape[1]) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "list"])

    listed = own.mapInArrow(assign, "key long, source_id string, classification_rank int, vector array<float>, list int")
    spread = F.pmod(F.xxhash64("key"), F.lit(max(1, n // (16 * PART))))
    listed.repartition("list", spread).sortWithinPartitions("list", "source_id", "key").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    held = spark.read.schema("key long, source_id string, classification_rank int, vector array<float>, list int").parquet(f"{folder}/lists") if n else listed
    held.groupBy("list", "source_id", "classification_rank").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/held")
    return folder


def search(spark: SparkSession, folder: str, searches: DataFrame, policy: DataFrame, k: int = 10, opened: float = OPENED) -> DataFrame:
    """search, key, score, rank (from 1) and nth (of the search's lists, from 0, that in which the row lies): for each of the `searches` (search: long, vector) the k best permitted rows of the lists it opens."""
    schema = "search long, key long, score double, nth int"
    centroids = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    if not centroids:
        return spark.createDataFrame([], schema + ", rank int")
    at = np.array([r["centroid"] for r in centroids])
    held = scoped(spark.read.parquet(f"{folder}/held"), policy).groupBy("list").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(at), np.int64)
    for r in held.collect():  # one row a list
        counts[r["list"]] = r["n"]
    probes = max(1, round(opened * len(at)))
    shared = spark.sparkContext.broadcast((at, counts))

    def choose(batches):
        """The lists that each search opens, those without permitted rows left out."""
        where, there = shared.value
        for b in batches:
            order = np.argsort(-(matrix(b.column("vector"), where.shape[1]) @ where.T), axis=1, kind="stable")
            upto = there[order].cumsum(1)
            need = np.maximum(probes, (upto < k).sum(1) + 1)
            take = (np.arange(len(where))[None] < need[:, None]) & (there[order] > 0)
            row, nth = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([b.column("search").take(pa.array(row)), b.column("vector").take(pa.array(row)), pa.array(order[row, nth].astype(np.int32)), pa.array(nth.astype(np.int32))], names=["search", "vector", "list", "nth"])

    asked = searches.where("vector is not null").select(F.col("search").cast("long").alias("search"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(choose, "search long, vector array<float>, list int, nth int")
    n_asked = searches.count()
    ways = max(1, -(-n_asked // ASKING))
    parts = F.element_at(F.array(*[F.lit(max(1, -(-int(c) // PART))) for c in counts]), F.col("list") + 1)
    drawn = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    questions = asked.withColumn("way", drawn("search", F.lit(ways))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    lists = sorted(int(i) for i in np.flatnonzero(counts))
    rows = scoped(spark.read.parquet(f"{folder}/lists"), policy).where(F.col("list").isin(lists)).select("list", "key", "vector")
    dealt = rows.withColumn("part", drawn("key", parts)).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(ours) or not len(theirs):
            return pa.table({"search": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "nth": pa.array([], pa.int32())})
        key, score = np.asarray(ours.column("key")), matrix(theirs.column("vector")) @ matrix(ours.column("vector")).T
        best = [np.lexsort((key, -np.round(s, 12)))[:k] if len(key) <= 4 * k else of_top(s, key) for s in score]
        one = np.repeat(np.arange(len(best)), [len(b) for b in best])
        found = np.concatenate(best)
        return pa.table({"search": theirs.column("search").take(pa.array(one)), "key": key[found], "score": score[one, found], "nth": theirs.column("nth").take(pa.array(one))})

    def of_top(s: np.ndarray, key: np.ndarray) -> np.ndarray:
        s = np.round(s, 12)
        left = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        return left[np.lexsort((key[left], -s[left]))[:k]]

    met = dealt.groupBy("list", "part", "way").cogroup(questions.groupBy("list", "part", "way")).applyInArrow(compare, schema)
    order = Window.partitionBy("search").orderBy(F.desc(F.round("score", 12)), "key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def opened_for(spark: SparkSession, folder: str, searches: DataFrame, policy: DataFrame, k: int = 10, recall: float = RECALL, tried: int = TRIED) -> float:
    """Share of the lists to open so that `recall` of the k best permitted rows are found, measured on up to `tried` of the searches, drawn by hash and answered from all lists."""
    some = searches.where("vector is not null").orderBy(F.xxhash64("search"), "search").limit(tried)
    nth = np.sort([r["nth"] for r in search(spark, folder, some, policy, k, 1.0).select("nth").collect()])  # tried * k numbers
    lists = spark.read.parquet(f"{folder}/centroids").count()
    return min(1.0, (int(nth[min(len(nth) - 1, int(np.ceil(recall * len(nth))))]) + 1) / lists) if len(nth) else OPENED
