"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks.

A source's documents are dealt by hash to shards of about `shard_tokens`, and laid end to end in a
seeded order within each. The line of a shard is cut into blocks of (nearly) `block` tokens, or a sixteenth of its source's target where that
is less; no source changes the blocks of another. Blocks are awarded by highest quotients, first to the sources (those with blocks of one size among themselves) by
their targets, then within a source to its shards by their tokens; so each shard has an integer quota. A quota of q of n blocks takes the whole
line q // n times, and q % n blocks more: a run of blocks (round the end) from a seeded start. As the order
is itself a seeded shuffle, a run is as good a draw as scattered blocks, and cuts three documents at most.

Only sums by source come to the driver; a source's shards are a few numbers each. Defined results: a null
text has size 0 and takes nothing; the null source is one source, the last; equal rows are
interchangeable; an empty table gives an empty result; columns named like a new one are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import add_columns, n_words

WEIGHTS = (5, 2, 1)
SEED = 7
BLOCK, SHARD_TOKENS = 64, 1_000_000
#: Blocks that each target is to have, where blocks of BLOCK would be too coarse for it.
LEAST_BLOCKS = 16
#: Places of the hash that are added up before sources are known, at least; there are as many as a 64th of the rows where that is more.
PLACES = 1 << 20


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets that add up to `share` of all sizes, by weight, none above `most` times its size; the excess goes to the others by weight."""
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    got = [0.0] * len(sizes)
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                got[i] = each * weights[i]
            break
        for i in full:
            got[i] = most * sizes[i]
            left -= got[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1); of equal quotients the earlier party's counts first.

    A divisor found by halving gives all seats but a few; the rest go one by one.
    """
    v = np.asarray(votes, float)
    if seats <= 0 or v.sum() <= 0:
        return [0] * len(v)
    # Too few seats at first: round down the quotients that clear the divisor, then award the rest.
    low, high = 0.0, v.max() * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(v / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    got = np.floor(v / high + 0.5).astype(np.int64)
    queue = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if v[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = queue[0]
        got[i] += 1
        heapq.heapreplace(queue, (-v[i] / (2 * got[i] + 1), i))
    return got.tolist()


def quotas_of(goal: Sequence[float], block: int | None = None) -> tuple[list[int], list[int]]:
    """Tokens in a block, and blocks, of each source: sources whose blocks are alike share the seats of their targets."""
    size = [block or max(1, min(BLOCK, int(g / LEAST_BLOCKS))) for g in goal]
    quota = [0] * len(size)
    for b in set(size):
        own = [i for i, x in enumerate(size) if x == b]
        for i, q in zip(own, sainte_lague([goal[i] for i in own], round(sum(goal[i] for i in own) / b))):
            quota[i] = q
    return size, quota


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int | None = None, shard_tokens: int = SHARD_TOKENS, seed: int = SEED, size: str | None = None) -> DataFrame:
    """Every row of `docs` with size, source_size, target, taken, and spans: array of {start, end}, the words taken, in order.

    A word twice in spans is taken twice. `size`: a column that already has the number of words.
    Sources take the weights in turn, in the order of their code points, null last. `block`: BLOCK tokens, less for a source
    whose target would have fewer than LEAST_BLOCKS of them.
    """
    places = 1 << max(PLACES.bit_length() - 1, (docs.count() // 64).bit_length())
    new = {"size", "source_size", "target", "taken", "spans"}
    kept = docs.select(*[c for c in docs.columns if c not in new], (F.col(f"`{size}`").cast("long") if size else n_words(F.col(f"`{text}`"))).alias("size"))
    keyed = kept.withColumn("__order", F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"), "size"))
    sums = materialize(keyed.select(F.col(f"`{source}`").cast("string").alias("s"), "size", F.pmod("__order", F.lit(places)).alias("h")).groupBy("s", "h").agg(F.sum("size").alias("n")), "sizes")
    # One row for each source.
    rows = sorted(((r[0], r[1]) for r in sums.groupBy("s").agg(F.sum("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in rows], [r[1] for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    blocks, quota = quotas_of(goal, block)
    plan = docs.sparkSession.createDataFrame([(i, n, int(s), float(g), max(1, -(-s // shard_tokens)), int(q), b) for i, (n, s, g, q, b) in enumerate(zip(names, sizes, goal, quota, blocks))], "__i int, __s string, source_size long, target double, __shards int, __quota long, __block long")

    def share_out(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__shard")
        n = np.where(group["n"] > 0, np.maximum(1, np.rint(group["n"] / group["block"])), 0).astype(np.int64)
        # No quota is above `most` times the blocks: what rounding gives beyond goes to the other shards.
        q = np.minimum(sainte_lague(group["n"].tolist(), int(group["quota"].iloc[0])), np.floor(most * n).astype(np.int64))
        spare = int(group["quota"].iloc[0]) - int(q.sum())
        for j in np.argsort(-n, kind="stable"):
            more = min(spare, int(most * n[j]) - int(q[j]))
            q[j] += more
            spare -= more
        return pd.DataFrame({"__i": group["__i"], "__shard": group["__shard"], "__tokens": group["n"], "__blocks": n, "__q": q})

    # `plan` has one row a source, made from the rows collected above.
    plan = F.broadcast(plan)
    parts = sums.join(plan, sums.s.eqNullSafe(F.col("__s"))).groupBy("__i", (F.col("h") % F.col("__shards")).cast("int").alias("__shard")).agg(F.sum("n").alias("n"), F.first("__quota").alias("quota"), F.first("__block").alias("block"))
    quotas = materialize(parts.groupBy("__i").applyInPandas(share_out, "__i int, __shard int, __tokens long, __blocks long, __q long"), "quotas")
    placed = keyed.join(plan, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__s"))).withColumn("__shard", (F.pmod("__order", F.lit(places)) % F.col("__shards")).cast("int")).drop("__s", "__shards", "__quota", "__block")
    line = Window.partitionBy("__i", "__shard").orderBy("__order", F.col(f"`{key}`"), "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("__at", F.coalesce(F.sum("size").over(line), F.lit(0))).join(quotas, ["__i", "__shard"])
    # Whole rounds, and a run of blocks of the line, in tokens; it may go on past the end, from 0.
    n = F.greatest("__blocks", F.lit(1))
    edge = lambda k: F.floor(k * F.col("__tokens") / n)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "__i", "__shard"), n)
    stop = start + F.col("__q") % n
    ranges = F.array(F.struct(edge(start).alias("a"), edge(F.least(stop, n)).alias("z")), F.struct(F.lit(0).cast("long").alias("a"), edge(F.greatest(stop - n, F.lit(0))).alias("z")))
    cut = F.filter(F.transform(ranges, lambda r: F.struct(F.greatest(r["a"] - F.col("__at"), F.lit(0)).alias("start"), F.least(r["z"] - F.col("__at"), F.col("size")).alias("end"))), lambda r: r["start"] < r["end"])
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")), F.when(F.col("size") > 0, F.floor(F.col("__q") / n).cast("int")).otherwise(0))
    done = at.withColumn("spans", F.concat(whole, F.array_sort(cut))).withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]))
    return done.drop("__i", "__shard", "__order", "__at", "__tokens", "__blocks", "__q")


def texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of mix() once for each time that words of it are taken, with those words only.

    A whole text comes unchanged; of a cut one the words and what lies between them.
    """
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def make():
        def work(texts_, starts, ends, sizes):
            out = []
            for t, a, z, n in zip(texts_, starts, ends, sizes):
                if t is not None and (a > 0 or z < n):
                    places = [m.span() for m in word.finditer(t)]
                    t = t[places[a][0] : places[z - 1][1]]
                out.append(t)
            return [out]

        return work

    each = mixed.withColumn("__span", F.explode("spans")).withColumns({"__start": F.col("__span.start"), "__end": F.col("__span.end")})
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "spans")]
    return add_columns(each, [text, "__start", "__end", "size"], [T.StructField(text, T.StringType())], make).select(columns)
