"""Hard-negative mining over a pivot table: distances to a few pivots, kept with each vector, bracket every score by the triangle inequality.

With M the largest norm, a vector v becomes (v, sqrt(M^2 - |v|^2)) and an anchor q becomes (q, 0): then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so that the largest
inner product is the least distance. The pivots are vectors of a bounded sample, each the farthest from those before it. For any pivot p,
|d(q,p) - d(v,p)| <= d(q,v) <= d(q,p) + d(v,p): two stored numbers bracket a score, and the ends of a block's distances bracket those of all
its vectors. What a bracket leaves open is computed exactly, in integers. The sample decides only how tight brackets are, and which scores are known from the start to be beaten.

Vectors lie in blocks of some MB, ordered by their nearest pivot; anchors, a stated set, in smaller ones. Pairs of blocks meet in a join on the
blocks' brackets, and each pair is worked on alone: at most `positives`, or `negatives` for each positive, leave it for each anchor, and windows merge them.

Defined results: vectors that are null or have a null component, and rows without a label, take no part; a shorter vector is as one with zeros at its
end; repeated rows are rows of their own, also as positives of each other; a null id is no anchor, and comes last in ties; equal scores go by id, then by row; an empty
table gives an empty result; other columns aren't looked at. Scores are exact as long as a hundred times a score fits in 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import short_batches

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies within these hundredths of its positive's.
LOW, HIGH = 50, 95
PIVOTS, SAMPLE = 8, 2048
#: Bytes of vectors in a block and in the sample, and vectors in a block of anchors.
BLOCK_BYTES, SAMPLE_BYTES, BLOCK_ANCHORS = 4 << 20, 16 << 20, 256
#: Bytes of anchors that may be sent to all executors. Beyond, blocks meet without that.
SENT_BYTES = 64 << 20
#: Anchors whose brackets are worked out at once.
CHUNK = 32
#: Of distances: what rounding may have done to them.
SLACK = 1e-6
#: No score is less.
NEVER = -(1 << 62)


@dataclass
class Space:
    """What brackets need: the pivots (lifted), dimensions, the largest squared norm; and the sample, whose scores tell what is beaten from the start."""

    pivots: np.ndarray
    dim: int
    most: float
    row: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        return np.hstack([v, np.sqrt(np.maximum(0, self.most - (v**2).sum(1)))[:, None]])

    def far(self, points: np.ndarray) -> np.ndarray:
        """Distances of lifted points to the pivots."""
        return np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * points @ self.pivots.T))


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """int64 matrix of a list column without nulls; shorter lists end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = np.asarray(column.flatten())
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, each of a with each of b; in floating point where that is exact."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if len(a) and len(b) and np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max() < 1 << 52:
        return np.rint(x @ y.T).astype(np.int64)
    return a @ b.T


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points: the first, then each time that which is farthest from all chosen."""
    chosen, near = [0] if len(points) else [], np.full(len(points), np.inf)
    while chosen:
        near = np.minimum(near, np.linalg.norm(points - points[chosen[-1]], axis=1))
        if len(chosen) == n or near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    return points[chosen]


def first(scores: np.ndarray, others: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the k highest scores, in order; ties go by the other keys, the most important first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return at[np.lexsort((*[x[at] for x in reversed(others)], -scores[at]))[:k]]


BLOCK = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(x, T.BinaryType()) for x in ("row", "id", "missing", "vector", "far", "floors", "ceilings")], T.StructField("label", T.ArrayType(T.StringType())), *[T.StructField(x, T.ArrayType(T.DoubleType())) for x in ("low", "high", "norms")], *[T.StructField(x, T.LongType()) for x in ("floor", "ceiling")]])


def packed(rows: DataFrame, shared, size: int, wanted: Callable[[Space, dict], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """A row for each `size` rows of a partition, in their order: their numbers as bytes, distances to the pivots and the ends of these.

    `wanted` makes anchors of them, with floors and ceilings of the scores that are looked for.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, extra = to_arrow_schema(BLOCK), [c for c in rows.columns if c == "scores"]

    def block(t: pa.Table) -> pa.RecordBatch:
        space = shared.value
        v = dense(t.column("v"), space.dim)
        far = space.far(space.lifted(v) if wanted is None else np.hstack([v, np.zeros((len(v), 1))]))
        norms = np.linalg.norm(v.astype(np.float64), axis=1)
        own = {"row": np.asarray(t.column("row")), "label": np.array(t.column("label").to_pylist(), object), "vector": v} | {c: t.column(c).to_pylist() for c in extra}
        floors, ceilings = wanted(space, own) if wanted else (np.zeros(0, np.int64),) * 2
        ends = (int(floors.min()), int(ceilings.max())) if floors.size else (NEVER, -NEVER)
        raw = [own["row"], np.asarray(t.column("id").fill_null(0)), np.asarray(t.column("id").is_null()), v, far, floors, ceilings]
        of = [len(v), *[x.tobytes() for x in raw], own["label"].tolist(), far.min(0).tolist(), far.max(0).tolist(), [norms.min(), norms.max()], *ends]
        return pa.RecordBatch.from_arrays([pa.array([x], type=k.type) for x, k in zip(of, kinds, strict=True)], schema=kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while n + b.num_rows >= size:
                yield block(pa.Table.from_batches([*held, b.slice(0, size - n)]).combine_chunks())
                b, held, n = b.slice(size - n), [], 0
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks())

    return rows.select("row", "id", "label", "v", *extra).mapInArrow(pack, BLOCK)


def brackets(anchors: dict, chunk: slice, block: dict, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of some anchors with all vectors of a block."""
    q, v = anchors["far"][chunk], block["far"]
    near, far = np.zeros((len(q), len(v))), np.full((len(q), len(v)), np.inf)
    for k in range(q.shape[1]):
        a, b = q[:, k, None], v[None, :, k]
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(far, a + b, out=far)
    square = (anchors["vector"][chunk].astype(np.float64) ** 2).sum(1)[:, None]
    slack = SLACK * (np.sqrt(square) + most**0.5) + 1e-9
    return (square + most - (far + slack) ** 2) / 2, (square + most - np.maximum(0, near - slack) ** 2) / 2 + 1e-6


def met(anchors: DataFrame, blocks: DataFrame, shared, bytes_of_anchors: int, same: bool, k: int) -> DataFrame:
    """For each anchor and each range of scores that it asks for, the k first rows of each block within, of its own label or of the others.

    anchor, place (of the range), row, id, score. Pairs of blocks whose brackets hold no wanted score don't meet.
    """
    a, b = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]), blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns if c not in ("floors", "ceilings", "floor", "ceiling")])
    a = F.broadcast(a) if bytes_of_anchors <= SENT_BYTES else a
    most = shared.value.most
    biggest = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: F.greatest(s, y))
    gap = F.greatest(biggest(F.zip_with("b_low", "a_high", lambda x, y: x - y)), biggest(F.zip_with("a_low", "b_high", lambda x, y: x - y)))
    reach = F.aggregate(F.zip_with("a_high", "b_high", lambda x, y: x + y), F.lit(float("inf")), lambda s, y: F.least(s, y))
    slack = SLACK * (F.col("a_norms")[1] + most**0.5) + 1e-9
    square = lambda x: x * x
    at_most = (square(F.col("a_norms")[1]) + most - square(F.greatest(F.lit(0.0), gap - slack))) / 2 + 1
    at_least = (square(F.col("a_norms")[0]) + most - square(reach + slack)) / 2 - 1
    pairs = a.crossJoin(b).where((at_most >= F.col("a_floor")) & (at_least <= F.col("a_ceiling"))).select(*a.columns, *b.columns)

    def unpack(b: pa.RecordBatch, i: int, side: str, dim: int) -> dict:
        of = lambda name, kind: np.frombuffer(b.column(f"{side}_{name}")[i].as_py(), kind)
        n = b.column(f"{side}_n")[i].as_py()
        return {"row": of("row", np.int64), "id": of("id", np.int64), "missing": of("missing", np.bool_), "vector": of("vector", np.int64).reshape(n, dim), "far": of("far", np.float64).reshape(n, -1), "label": b.column(f"{side}_label")[i].as_py()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = unpack(batch, i, "a", space.dim), unpack(batch, i, "b", space.dim)
                floors, ceilings = (np.frombuffer(batch.column(c)[i].as_py(), np.int64).reshape(len(q["row"]), -1) for c in ("a_floors", "a_ceilings"))
                codes: dict = {}
                ql, vl = (np.array([codes.setdefault(x, len(codes)) for x in s["label"]], np.int64) for s in (q, v))
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for at in range(0, len(ql), CHUNK):
                    chunk = slice(at, at + CHUNK)
                    low, high = brackets(q, chunk, v, space.most)
                    open_ = (high >= floors[chunk].min(1)[:, None]) & (low <= ceilings[chunk].max(1)[:, None]) & ((ql[chunk, None] == vl[None]) == same) & (q["row"][chunk, None] != v["row"][None])
                    # A product of all is dearer only where few are left.
                    every = products(q["vector"][chunk], v["vector"]) if open_.mean() > 0.02 else None
                    for j in np.flatnonzero(open_.any(1)).tolist():
                        left = np.flatnonzero(open_[j])
                        s = every[j, left] if every is not None else products(q["vector"][at + j : at + j + 1], v["vector"][left])[0]
                        for place, (f, c) in enumerate(zip(floors[at + j].tolist(), ceilings[at + j].tolist())):
                            own = np.flatnonzero((s >= f) & (s <= c))
                            own = own[first(s[own], tuple(v[x][left[own]] for x in ("missing", "id", "row")), k)]
                            for to, x in zip(out, (np.full(len(own), q["row"][at + j]), np.full(len(own), place), v["row"][left[own]], left[own], s[own])):
                                to.append(x)
                if out[0]:
                    anchor, place, row, left, s = (np.concatenate(x).astype(np.int64) for x in out)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(row), pa.array(v["id"][left], mask=v["missing"][left]), pa.array(s)], names=["anchor", "place", "row", "id", "score"])

    return pairs.mapInArrow(look, "anchor long, place int, row long, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor and place, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id: str = "id", label: str = "label", vector: str = "vector", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """For each row for which `anchor` is true: its first `positives` rows of the same label, and for each of these its first `negatives` rows of other labels in range.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Vectors are arrays of whole numbers; scores are their inner products, the highest first.
    """
    session = rows.sparkSession
    with short_batches(session, 8 * BLOCK_ANCHORS):
        asks = F.coalesce(anchor & F.col(f"`{id}`").isNotNull(), F.lit(False)).alias("asks")
        took = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<bigint>").alias("v"), asks)
        took = took.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda x: x.isNull()), F.lit(True)))
        points = materialize(took.withColumn("row", F.monotonically_increasing_id()), "vectors")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, asked, dim, most = points.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
        dim = max(1, dim)
        drawn = points.orderBy(F.xxhash64("row"), "row").limit(max(1, min(sample, SAMPLE_BYTES // (8 * dim)))).select("row", "label", "v").toArrow()
        space = Space(np.zeros((1, dim + 1)), dim, most, np.asarray(drawn.column("row")), np.array(drawn.column("label").to_pylist(), object), dense(drawn.column("v"), dim))
        if len(drawn):
            space.pivots = farthest_first(space.lifted(space.vector), pivots)
        shared = session.sparkContext.broadcast(space)

        size = max(64, BLOCK_BYTES // (8 * dim))
        cell = F.col("cell")
        blocks = materialize(packed(near_pivots(points, shared).repartition(max(1, -(-n // size)), "row").sortWithinPartitions(cell["pivot"], cell["distance"], "row"), shared, size), "pivot-table")

        def beaten(space: Space, own: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
            """Scores of anchors with the sample, and where these count."""
            return products(own["vector"], space.vector), ((own["label"][:, None] == space.label[None]) == same) & (own["row"][:, None] != space.row[None])

        def want_positives(space: Space, own: dict) -> tuple[np.ndarray, np.ndarray]:
            s, counts = beaten(space, own, True)
            s = np.hstack([np.where(counts, s, NEVER), np.full((len(s), positives), NEVER)])
            return np.partition(s, s.shape[1] - positives, axis=1)[:, s.shape[1] - positives, None], np.full((len(s), 1), -NEVER)

        def want_negatives(space: Space, own: dict) -> tuple[np.ndarray, np.ndarray]:
            s, counts = beaten(space, own, False)
            p = np.array([(x + [None] * positives)[:positives] for x in own["scores"]], object)
            there = p != None  # noqa: E711
            p = np.where(there, p, 0).astype(np.int64)
            # No score is in the range of a positive that isn't there.
            floors, ceilings = np.where(there, -(-low * p // 100), -NEVER), np.where(there, high * p // 100, NEVER)
            for i in range(positives):
                within = np.where(counts & (s >= floors[:, i, None]) & (s <= ceilings[:, i, None]), s, NEVER)
                within = np.hstack([within, np.full((len(s), negatives), NEVER)])
                floors[:, i] = np.maximum(floors[:, i], np.partition(within, within.shape[1] - negatives, axis=1)[:, within.shape[1] - negatives])
            return floors, ceilings

        per_task = 16 * BLOCK_ANCHORS
        bytes_of_anchors = asked * (8 * dim + 8 * pivots + 16 * positives + 64)
        questions = points.where("asks").drop("asks")
        dealt = lambda q: q.repartition(max(1, -(-asked // per_task)), "row")
        first_blocks = materialize(packed(dealt(questions), shared, BLOCK_ANCHORS, want_positives), "anchors")
        with short_batches(session, 4):
            near = materialize(met(first_blocks, blocks, shared, bytes_of_anchors, True, positives), "near")
        best = materialize(ranked(near, positives).select("anchor", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        of_each = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
        second = questions.join(of_each.withColumnRenamed("anchor", "row"), "row")
        second_blocks = materialize(packed(dealt(second), shared, BLOCK_ANCHORS, want_negatives), "ranges")
        with short_batches(session, 4):
            between = materialize(met(second_blocks, blocks, shared, bytes_of_anchors, False, negatives), "between")
    found = ranked(between, negatives).select("anchor", (F.col("place") + 1).alias("positive"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = questions.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(best, ["anchor", "positive"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def near_pivots(points: DataFrame, shared) -> DataFrame:
    """`points` with the nearest pivot and the distance to it, which give blocks their order."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            far = space.far(space.lifted(dense(b.column("v"), space.dim)))
            cell = pa.StructArray.from_arrays([pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], names=["pivot", "distance"])
            yield pa.RecordBatch.from_arrays([*b.columns, cell], names=[*b.schema.names, "cell"])

    return points.mapInArrow(measure, T.StructType([*points.schema.fields, T.StructField("cell", T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("distance", T.DoubleType())]))]))
