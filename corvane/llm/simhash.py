"""SimHash near-duplicates: fingerprints, a vantage-point tree that deals them out by Hamming distance, and components.

Two fingerprints x, y within `radius` bits have a point z between them, at most half the radius (rounded
up) from each. A node of the tree sends what lies within the radius `mu` of its vantage point one way
and the rest the other. A fingerprint goes to every leaf that a ball of half the radius round it touches:
the triangle inequality prunes the other branches. x and y then meet in the leaf of z, so that no pair
is lost; each leaf goes on splitting by vantage points of its own and compares small blocks exactly.
A leaf returns links that join what it found joined (at most one a member and block), never all pairs.

Defined results: texts without words have fingerprint 0 and link like any other; equal fingerprints
are one point; a null id counts only where no other id is in the component; empty tables give empty
results; repeated rows keep their row; columns named like a new one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import add_columns

SEED = 42
#: Fingerprints from which the tree is built; it grows no deeper than this sample can tell.
SAMPLE = 32_768
#: Fingerprints that a leaf of the tree should hold, and that are compared all with all at once.
LEAF, BLOCK = 1_024, 512
#: Shingles whose bits are counted at once.
CHUNK = 255 * 64


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits as a signed integer: the majority of the bits of the XXH64 of each shingle."""
    import xxhash

    ws = (text or b"").lower().split()
    if not ws:
        return 0
    flat, n = b" ".join(ws), min(shingle, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ws) - n + 1].tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[n - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(flat[a:z], SEED) for a, z in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        # Rows are added as bytes, 255 at most, which is much faster than in wider integers.
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with fp (long)."""
    with_bytes = docs.withColumn("__bytes", F.col(f"`{text}`").cast("binary"))
    return add_columns(with_bytes, ["__bytes"], [T.StructField("fp", T.LongType())], lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], drop=("__bytes", *drop))


def distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def split(points: np.ndarray, half: int, tries: int = 4) -> tuple[int, int, np.ndarray] | None:
    """Vantage point and mu that leave the least work in the two sides, and the distances; None if no split helps.

    The candidates are points at fixed places, so that reruns agree.
    """
    best = None
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        d = distance(points, v)
        upto = np.cumsum(np.bincount(d, minlength=66 + half)).astype(float)
        left = upto[half : 65 + half]
        right = len(points) - np.concatenate([np.zeros(half), upto])[:65]
        work = left**2 + right**2
        mu = int(work.argmin())
        if best is None or work[mu] < best[0]:
            best = (work[mu], int(v), mu, d)
    return best[1:] if best and best[0] < 0.9 * len(points) ** 2 else None


def grow(sample: np.ndarray, depth: int, half: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, mu, left, right); a child below 0 is the leaf -1 - child. An empty list: one leaf, 0."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def node(points: np.ndarray, level: int) -> int:
        nonlocal leaves
        found = split(points, half) if level < depth and len(points) >= 16 else None
        if not found:
            leaves += 1
            return -leaves
        v, mu, d = found
        nodes.append(())  # type: ignore[arg-type]
        at = len(nodes) - 1
        nodes[at] = (v, mu, node(points[d <= mu], level + 1), node(points[d > mu], level + 1))
        return at

    node(sample, 0)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], half: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and the places of the points that reach them."""
    leaf, place = [], []
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            leaf.append(np.full(len(own), -1 - at))
            place.append(own)
            continue
        v, mu, left, right = nodes[at]
        d = distance(points[own], v).astype(int)
        todo += [(left, own[d - half <= mu]), (right, own[d + half > mu])]
    return (np.concatenate(leaf), np.concatenate(place)) if leaf else (np.zeros(0, int), np.zeros(0, int))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give what the pairs (a, b) join one label, the smallest; `label` maps places to such labels."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label[:] = further


def links(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join all distinct points within `radius` bits of each other, through chains of such points."""
    half, found, todo = (radius + 1) // 2, [], [np.unique(points)]
    while todo:
        own = todo.pop()
        cut = split(own, half) if len(own) > BLOCK else None
        if cut:
            _, mu, d = cut
            d = d.astype(int)
            todo += [own[d - half <= mu], own[d + half > mu]]
            continue
        label = np.arange(len(own))
        for at in range(0, len(own), BLOCK):
            a, b = np.nonzero(np.bitwise_count(own[at : at + BLOCK, None] ^ own[None, :]) <= radius)
            join_labels(label, (a + at)[a + at < b], b[a + at < b])
        joined = np.flatnonzero(label != np.arange(len(own)))
        found.append((own[joined], own[label[joined]]))
    return found


def near_pairs(points: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of `points`: as many as join each component.

    The tree comes from at most about `sample` fingerprints, so that its size is bounded; only its shape,
    never the result, depends on them. What a leaf holds beyond `leaf` is split again in its task.
    """
    half, n = (radius + 1) // 2, points.count()
    some = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    # A row is one long: a bounded number of them, to lay out the tree.
    known = np.sort(np.array([r[0] for r in some.collect()], np.int64).view(np.uint64))
    nodes = grow(known, max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))), half)

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            leaves, place = route(fp.view(np.uint64), nodes, half)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(fp[place], pa.int64())], names=["leaf", "fp"])

    def compare(group: pa.Table) -> pa.Table:
        got = links(group.column("fp").to_numpy().view(np.uint64), radius)
        cat = lambda k: pa.array(np.concatenate([x[k] for x in got]).view(np.int64) if got else [], pa.int64())
        return pa.table({"a": cat(0), "b": cat(1)})

    return points.select("fp").mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every end of the edges (a, b): root is the smallest node reachable.

    Alternating large and small stars; each round is written, so that lineage and memory stay bounded.
    The minima are written before they are joined: both sides of the join are then shuffled, and Spark
    splits the tasks of a node with very many edges.
    """

    def minima(e: DataFrame, label: str) -> DataFrame:
        return materialize(e.groupBy("u").agg(F.min("v").alias("m")), label)

    pair = lambda u, v: F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = materialize(edges.where("a <> b").select(pair(F.col("a"), F.col("b")).alias("p")).select("p.*").distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both, "large").select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = minima(large, "small")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*")
        e = materialize(small.where("u <> v").distinct(), "small-star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 2, shingle: int = 3, keep_text: bool = True) -> DataFrame:
    """Every row of `docs` with fp, component_id (the smallest key in its component) and representative (true for one row of each).

    The representative is the first row with the smallest key. Without keep_text the text is left out.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    own = materialize(fingerprints(numbered, text, shingle, () if keep_text else (text,)), "fingerprints")
    best = F.min(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col("__row").alias("row")))
    points = materialize(own.groupBy("fp").agg(best.alias("best")), "points")
    members = materialize(components(near_pairs(points.select("fp"), radius)), "members")
    linked = materialize(members.join(points, members.node == points.fp).select("fp", "root", "best"), "linked")
    roots = materialize(linked.groupBy("root").agg(F.min("best").alias("best")), "roots")
    joined = linked.drop("best").join(roots, "root").select("fp", F.col("best").alias("joined"))
    chosen = materialize(points.join(joined, "fp", "left").select("fp", F.coalesce("joined", "best").alias("__best")), "chosen")
    return own.join(chosen, "fp").withColumns({"component_id": F.col("__best.key"), "representative": F.col("__best.row") == F.col("__row")}).drop("__best", "__row")
