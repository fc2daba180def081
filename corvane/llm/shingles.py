"""Near copies by word shingles: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and components.

Texts with equal sets are one point. MinHash bands tell only which points belong together: a pair of similarity s shares a band with probability
1 - (1 - s^rows)^bands; at 0.8, 25 bands of 5 miss 5 of 100,000 pairs, and fewer above. All else is exact, and nothing is capped.

First op2's way: a fingerprint of each set, and the vantage-point tree of simhash.py, in which a ball of half the radius round each fingerprint decides which leaves it
reaches; what meets within TREE_RADIUS bits is compared exactly. At a similarity of 0.8 about 10 bits of 64 differ, for which the tree prunes next to nothing, so bands find what lies farther apart.

The least point of a band leads it. Each point is also compared with one leader, that with which it shares most bands, which joins large groups
by one pair a member. Bands that are still of more than one component then join their points to families. Within a family an exact
set-similarity join finds what links: shingles are ordered by how many of the family's points have them, the rarest first; of two similar sets the smaller has a
shingle of the other among its first (1 - 2s/(1+s)) n + 1, and that is among the first (1 - s) m + 1 of the larger; where the first and the last of such shingles
are bounds how many the sets share. What a template gives to all its texts comes late in that order, and so makes no pairs. Points of one
component are never compared. A family is one task as long as it has at most BLOCK shingles; a larger one is cut into blocks, every two of which meet, but for those of
its largest component among themselves.

Defined results: texts without words are equal; one of fewer than five words is one shingle; a null id counts only
where no other id is in the component; repeated rows keep their row; an empty table gives an empty result; columns named
like a new one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, materialize
from .common import add_columns
from .simhash import SEED, components, near_pairs

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Bits within which the tree finds fingerprints.
TREE_RADIUS = 2
#: Shingles in a block of a family.
BLOCK = 1 << 20
#: Bits of a point's marks: each shingle sets one.
MARKS = 512
#: Parts of a point's pairs, so that a point with very many isn't one task's.
PARTS = 64
#: Shingles whose hashes are mixed at once.
CHUNK = 4096


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of the XXH64 of each shingle."""
    import xxhash

    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    flat, n = b" ".join(ws), min(shingle, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ws) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:z], SEED) for a, z in zip(starts, ends[n - 1 :].tolist())), np.uint64, len(starts)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def marks_of(own: np.ndarray) -> list[int]:
    """MARKS bits as signed 64-bit integers. Bits in which two differ are never more than the shingles in which their sets differ."""
    bits = np.zeros(MARKS, bool)
    bits[(own % np.uint64(MARKS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def band_hashes(own: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit integer for each band of minima; none for an empty set."""
    import xxhash

    if not len(own):
        return []
    mix = np.random.default_rng(SEED).integers(0, 1 << 63, (2, bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(own), CHUNK):
        x = own[None, at : at + CHUNK] * mix[0] + mix[1]
        np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1), out=low)
    return [int(np.uint64(xxhash.xxh64_intdigest(m.tobytes(), k)).view(np.int64)) for k, m in enumerate(low.reshape(bands, rows))]


def set_fingerprint(own: np.ndarray) -> int:
    """op2's majority of bits, of a set of shingles, as a signed 64-bit integer; 0 for an empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def tree_pairs(points: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of `points` (p, fp) that op2's tree brings together; of equal fingerprints each point with the least."""
    heads = materialize(points.groupBy("fp").agg(F.min("p").alias("head")), "fingerprint-heads")
    found = materialize(near_pairs(heads.select("fp"), radius), "tree-links")
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"of_{c}"))
    apart = found.join(head("a"), "a").join(head("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return apart.unionByName(points.join(heads, "fp").where("p <> head").select(F.col("head").alias("a"), F.col("p").alias("b")))


def points_of(docs: DataFrame, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """`docs` with __set (a long, equal for equal sets of shingles), __n (its size), __bands and __fp."""
    import xxhash

    def make():
        def work(texts):
            sets = [shingles(t, shingle) for t in texts]
            return [[int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) for s in sets], [len(s) for s in sets], [band_hashes(s, bands, rows) for s in sets], [set_fingerprint(s) for s in sets]]

        return work

    fields = [T.StructField("__set", T.LongType()), T.StructField("__n", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__fp", T.LongType())]
    return add_columns(docs.withColumn("__bytes", F.col(f"`{text}`").cast("binary")), ["__bytes"], fields, make, drop=("__bytes",))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of points whose texts (point, text) are similar enough."""

    def make():
        def work(a, b):
            return [[jaccard(shingles(x, shingle), shingles(y, shingle)) for x, y in zip(a, b)]]

        return work

    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    left = dealt.select("a", "part").distinct().join(texts.toDF("a", "ta"), "a")
    both = dealt.join(texts.toDF("b", "tb"), "b").join(left, ["a", "part"])
    return add_columns(both, ["ta", "tb"], [T.StructField("s", T.DoubleType())], make, drop=("ta", "tb", "part")).where(F.col("s") >= similarity).select("a", "b")


def similar_pairs(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that are similar enough, of different labels: as many as join what belongs together. Where there are two sides, pairs of one side aren't looked at."""
    size = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], owner))
    owner, code = owner[order], code[order]
    starts = np.cumsum(size) - size
    place = np.arange(len(owner)) - starts[owner]
    least = lambda share: size - np.ceil(share * size - 1e-6).astype(int) + 1
    looks = (count[code] > 1) & (place < least(similarity)[owner])
    found = looks & (place < least(2 * similarity / (1 + similarity))[owner])

    # Sets go by their size; for each shingle the sets, in that order, that are found by it.
    by_size = np.lexsort((np.arange(len(sets)), size))
    rank = np.empty(len(sets), int)
    rank[by_size] = np.arange(len(sets))
    listed = np.flatnonzero(found)
    listed = listed[np.lexsort((rank[owner[listed]], code[listed]))]
    in_rank, in_place, ends = rank[owner[listed]], place[listed], np.searchsorted(code[listed], np.arange(len(count) + 1))
    smallest = np.searchsorted(size[by_size], np.ceil(similarity * size - 1e-6))
    marks = np.array([marks_of(s) for s in sets], np.int64).reshape(len(sets), -1).view(np.uint64)
    two, label, links = len(np.unique(side)) > 1, label.copy(), []
    for y in by_size.tolist():
        own = np.flatnonzero(looks[starts[y] : starts[y] + size[y]]) + starts[y]
        spans = []
        for c, j in zip(code[own].tolist(), place[own].tolist()):
            a, z = ends[c], ends[c + 1]
            if a < z:
                a, z = a + np.searchsorted(in_rank[a:z], [smallest[y], rank[y]])
                if a < z:
                    spans.append((a, z, j))
        if not spans:
            continue
        at = np.concatenate([np.arange(a, z) for a, z, _ in spans])
        other, i, j = by_size[in_rank[at]], in_place[at], np.repeat([s[2] for s in spans], [z - a for a, z, _ in spans])
        fit = (label[other] != label[y]) & ((side[other] != side[y]) | (not two))
        other, i, j = other[fit], i[fit], j[fit]
        x, first, shared = np.unique(other, return_index=True, return_counts=True)
        if not len(x):
            continue
        last = len(other) - 1 - np.unique(other[::-1], return_index=True)[1]
        need = similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6
        least_of = lambda at: np.minimum(size[x] - i[at], size[y] - j[at])
        differ = np.bitwise_count(marks[x] ^ marks[y]).sum(1)
        fit = (least_of(first) >= need) & (shared + least_of(last) - 1 >= need) & (size[x] + size[y] - differ >= 2 * need)
        for k in np.flatnonzero(fit)[np.argsort(-shared[fit], kind="stable")].tolist():
            if label[x[k]] != label[y] and len(np.intersect1d(sets[x[k]], sets[y], assume_unique=True)) >= need[k]:
                links.append((int(x[k]), y))
                label[label == label[x[k]]] = label[y]
    return links


def families(open_: DataFrame) -> DataFrame:
    """Points (p, n, root) of bands, each with its family and the pairs of blocks (i, j) in which it is on a side: what shares a band is a family."""
    heads = materialize(open_.groupBy("band").agg(F.min("p").alias("head")), "open-heads")
    of = components(open_.join(heads, "band").select(F.col("head").alias("a"), F.col("p").alias("b")))
    each = materialize(open_.select("p", "n", "root").distinct().join(of.select(F.col("node").alias("p"), F.col("root").alias("family")), "p"), "families")
    parts = each.groupBy("family", "root").agg(F.sum("n").alias("n"))
    sizes = parts.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    whole = F.col("all") <= BLOCK
    sizes = materialize(sizes.select("family", F.col("main.root").alias("main"), F.when(whole, 0).otherwise(blocks(F.col("main.n"))).alias("mains"), F.when(whole, 1).otherwise(blocks(F.col("all") - F.col("main.n"))).alias("rest")), "sizes")
    is_main = (F.col("mains") > 0) & (F.col("root") == F.col("main"))
    drawn = lambda n: F.pmod(F.xxhash64("p"), n).cast("int")
    dealt = each.join(broadcast_if_small(sizes), "family").withColumn("b", F.when(is_main, drawn(F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + drawn(F.col("rest"))))
    others = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rest") - 1)
    met = dealt.select("family", "p", "root", "b", F.explode(others).alias("c"))
    return met.select("family", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "p", "root", (F.col("b") > F.col("c")).cast("int").alias("side"))


def linked_in_families(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between points of a family that are similar enough; `sets` has p and its set as bytes."""

    def compare(group: pa.Table) -> pa.Table:
        own, label = np.asarray(group.column("p")), np.asarray(group.column("root"))
        pairs = similar_pairs([np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()], label, np.asarray(group.column("side")), similarity)
        return pa.table({"a": pa.array([own[a] for a, _ in pairs], pa.int64()), "b": pa.array([own[b] for _, b in pairs], pa.int64())})

    return met.join(sets, "p").groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every row of `docs` with component_id (the smallest key in its component) and representative (true for one row of each)."""
    numbered = docs.drop("component_id", "representative").withColumn("__row", F.monotonically_increasing_id())
    own = materialize(points_of(numbered, text, shingle, bands, rows), "shingled")
    best = F.min(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col("__row").alias("row")))
    points = materialize(own.groupBy("__set").agg(best.alias("best"), F.first("__n").alias("n"), F.first("__bands").alias("bands"), F.first("__fp").alias("fp")), "points")
    near = materialize(tree_pairs(points.select(F.col("__set").alias("p"), "fp"), TREE_RADIUS), "tree-candidates")

    alike = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
    each = points.select(F.explode("bands").alias("band"), F.col("__set").alias("p"), "n")
    low = each.groupBy("band").agg(F.min(F.struct("p", "n")).alias("low"), F.count("*").alias("members")).where("members > 1")
    heads = materialize(low, "heads")
    shared = materialize(each.join(heads, "band"), "shared")
    chosen = points.join(broadcast_if_small(materialize(shared.select(F.col("p").alias("__set")).union(near.select("a")).union(near.select("b")).distinct(), "met")), "__set").select("__set", F.col("best.row").alias("__row"))
    texts = materialize(own.select("__row", F.col(f"`{text}`").cast("binary").alias("t")).join(broadcast_if_small(materialize(chosen, "chosen")), "__row").select("__set", "t"), "texts")

    # One leader a point at first, that with which it shares most bands: most of a large group is one component then.
    led = shared.where((F.col("p") != F.col("low.p")) & alike(F.col("n"), F.col("low.n"))).withColumn("head", F.col("low.p"))
    nearest = led.groupBy("p", "head").agg(F.count("*").alias("bands")).groupBy("p").agg(F.min(F.struct((-F.col("bands")).alias("less"), "head"))["head"].alias("a"))
    links = materialize(confirmed(materialize(nearest.select("a", F.col("p").alias("b")).unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "nearest-candidates"), texts, shingle, similarity), "nearest")
    members = materialize(components(links), "members")

    # Then all points of bands that aren't one component yet, by family.
    rooted = materialize(shared.drop("low", "members").join(members.select(F.col("node").alias("p"), "root"), "p", "left").withColumn("root", F.coalesce("root", "p")), "rooted")
    mixed = materialize(rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band"), "mixed")
    met = materialize(families(materialize(rooted.join(mixed, "band"), "open")), "met-blocks")
    wanted = broadcast_if_small(materialize(met.select(F.col("p").alias("__set")).distinct(), "wanted"))
    sets = add_columns(texts.join(wanted, "__set"), ["t"], [T.StructField("set", T.BinaryType())], lambda: lambda ts: [[shingles(t, shingle).tobytes() for t in ts]], drop=("t",))
    more = materialize(linked_in_families(met, materialize(sets.withColumnRenamed("__set", "p"), "sets"), similarity), "in-families")
    if not more.isEmpty():
        members = materialize(components(links.unionByName(more)), "members")

    linked = materialize(members.join(points, members.node == points["__set"]).select("__set", "root", "best"), "linked")
    roots = materialize(linked.groupBy("root").agg(F.min("best").alias("best")), "roots")
    joined = linked.drop("best").join(roots, "root").select("__set", F.col("best").alias("joined"))
    final = materialize(points.join(joined, "__set", "left").select("__set", F.coalesce("joined", "best").alias("__best")), "final")
    return own.drop("__n", "__bands", "__fp").join(final, "__set").withColumns({"component_id": F.col("__best.key"), "representative": F.col("__best.row") == F.col("__row")}).drop("__best", "__row", "__set")
