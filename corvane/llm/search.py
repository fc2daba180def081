"""Exact BM25 top-k: an inverted index written by shard, block-max WAND pruning in each, merged exactly under global statistics.

A text is indexed and searched for once, whatever its copies: an indexed one holds the keys of all of them, in their order, and counts as
many documents; of a document among the best, its k first keys are found. Of equal queries one is searched, and each has its rows.

A shard is a run of documents of one task, of bounded text, in the order of their lengths. Its postings are
written once, one row a shard. Documents are cut into blocks of BLOCK; each long list of postings has a largest weight in each
block, each short one a largest weight in the shard. For a query, the lists of a shard are sorted by how many documents they have,
the most first, which is the order in which their cursors would reach a next document. The bounds are added up in this order; the
list at which the sum reaches a share of the threshold is the pivot. Lists from the pivot on are walked: short ones one after the other, long ones of
several queries as one product of matrices. Those before it
aren't: a document with nothing else can't be among the best k, and only documents that their own weights so far and their block's
bounds let through are looked up in them, list after list, until the bounds of those left can't lift them any more. Blocks
that no document gets through are skipped.

The threshold is a query's k-th score so far. One shard in FIRST is searched first, by all queries; its lists give the thresholds
with which the others begin, so that these needn't find good documents again. Each task keeps each query's best k.

Document frequencies, the number of documents and their mean length cover all documents; they come from the written
index. Queries are sent to the tasks in groups of at most `max_terms` terms; each group is searched, its lists written and its
broadcast destroyed before the next: for each the index is read again, not the documents. Queries that are a share of the
documents make work grow with the square of the input, however much is skipped.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, told apart by 64-bit XXH64; a null text has none; a
query without words, or without matches, has no rows; only documents with a positive score are found; equal
scores (to 9 digits) go by key, null keys last; repeated rows are found each; each row of queries is a query of its own, also where
keys repeat or are null (`query` tells them apart); an empty table gives an empty result; keys that aren't integers are an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import forget, one_thread, short_batches
from .lm import Hasher

K1, B = 1.2, 0.75
BLOCK, SHARD_BYTES, SHARD_ROWS = 64, 40_000_000, 8_192
#: A list is long if it has more than one in so many documents of its shard.
LONG = 8
#: One in so many shards is searched first, for the thresholds.
FIRST = 8
MAX_TERMS = 4_000_000
INDEX = "shard long, n int, keys binary, known binary, copies binary, lengths binary, terms binary, df binary, docs binary, tf binary"
#: Bounds are sums in another order than scores: so much more, for rounding. Scores are rounded, so that equal documents tie in every shard.
ROUND, DIGITS, SAME = 1 + 1e-9, 9, 1e-9
#: Long lists that are looked up at once.
LOOK = 8
#: Queries that are searched in a shard together: their sums over long lists are one product of matrices.
TOGETHER = 64
#: Documents that are looked up in one round, without the most promising ones first.
MANY = 256
#: The lists before the pivot stay below this share of the threshold, so that few documents need them looked up.
PIVOT = 0.6


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, end), one range after the other."""
    n = ends - starts
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(starts - first, n)


def _terms(words: Hasher, text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct terms of a text in order, their counts, and the number of words."""
    h = words.hashes((text or b"").lower().split())
    term, count = np.unique(h, return_counts=True)
    return term, count.astype(np.int32), len(h)


def _packed(counts: np.ndarray) -> bytes:
    """Integers from 0 on, in one, two, four or eight bytes each, as the largest asks for."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _unpacked(raw, n: int) -> np.ndarray:
    """`n` integers of _packed()."""
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, np.uint8)


def _row(number: int, keys: list[int | None], parts: list[tuple[np.ndarray, np.ndarray, int]], copies: list[int] | None = None) -> pa.RecordBatch:
    """A shard as a row of INDEX: documents in order of length, postings by term, then document.

    copies: how many of `keys`, one after the other and in the order of equal scores, belong to each document; one without it.
    """
    order = np.array(sorted(range(len(parts)), key=lambda i: (parts[i][2], i)), np.int64)
    many = np.array(copies or [1] * len(parts), "<i4")
    first = np.cumsum(many) - many
    own = [keys[i] for i in spread(first[order], (first + many)[order]).tolist()]
    n = np.array([len(parts[i][0]) for i in order])
    term, tf = (np.concatenate([parts[i][k] for i in order]) for k in (0, 1))
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = np.argsort(term, kind="stable")
    term = term[at]
    ends = np.append(np.flatnonzero(term[1:] != term[:-1]) + 1, len(term)) if len(term) else np.zeros(0)
    terms = term[ends.astype(np.int64) - 1] if len(term) else term
    columns = (np.array([x or 0 for x in own], "<i8"), np.array([x is not None for x in own], np.uint8), many[order], np.array([parts[i][2] for i in order], "<i4"), terms)
    posted = [_packed(np.diff(ends.astype("<i8"), prepend=0)), _packed(doc[at]), _packed(tf[at])]
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(parts)], pa.int32()), *[pa.array([c], pa.binary()) for c in (*[c.tobytes() for c in columns], *posted)]], names=names)


@dataclass
class Index:
    """shards: a written table of INDEX; frequencies: (h, df) of every term, written; n documents of so many words in the mean."""

    shards: DataFrame
    frequencies: DataFrame
    n: int
    mean: float


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> Index:
    """Index all documents: one row a shard, written, and the statistics over all shards."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"keys are integers: {key} is {docs.schema[key].dataType.simpleString()}")

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        words, keys, copies, parts, size, number = Hasher(), [], [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for t, known, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                keys += sorted(known) + [None] * (n - len(known))
                copies.append(n)
                parts.append(_terms(words, t))
                size += len(t)
                if size >= SHARD_BYTES or len(parts) >= shard_rows:
                    yield _row(number, keys, parts, copies)
                    keys, copies, parts, size, number = [], [], [], 0, number + 1
        if parts:
            yield _row(number, keys, parts, copies)

    # A text is indexed once, with the keys of all its copies.
    each = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("t"))
    texts = each.groupBy(F.sha2("t", 256).alias("digest")).agg(F.first("t").alias("t"), F.collect_list("k").alias("known"), F.count("*").alias("n"))
    shards = materialize(texts.select("t", "known", "n").mapInArrow(run, INDEX), "index")

    def frequencies(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, size, docs_, copies in zip(*[b.column(i).to_pylist() for i in range(4)]):
                h = np.frombuffer(terms, "<i8")
                ends = np.cumsum(_unpacked(size, len(h)), dtype=np.int64)
                if len(h):
                    df = np.add.reduceat(np.frombuffer(copies, "<i4")[_unpacked(docs_, int(ends[-1]))], np.append(0, ends[:-1]), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(df)], names=["h", "df"])

    def totals(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(np.frombuffer(n, "<i4"), np.frombuffer(x, "<i4").astype(np.int64)) for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(n.sum(dtype=np.int64)) for n, _ in each)], pa.int64()), pa.array([sum(int(n @ x) for n, x in each)], pa.int64())], names=["n", "words"])

    with short_batches(docs.sparkSession, 1):
        counts = materialize(shards.select("terms", "df", "docs", "copies").mapInArrow(frequencies, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")), "frequencies")
    n, words = shards.select("copies", "lengths").mapInArrow(totals, "n long, words long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "words")]).first()
    return Index(shards, counts, n, words / max(n, 1))


@dataclass
class Seen:
    """Blocks of all searches, and those of which documents were looked up; postings of the queries' terms, those walked, and lookups."""

    blocks: int = 0
    blocks_scored: int = 0
    postings: int = 0
    walked: int = 0
    looked_up: int = 0


@dataclass
class Shard:
    """A row of INDEX with weights, block bounds, and the long lists as rows over all documents."""

    n: int
    keys: np.ndarray
    known: np.ndarray
    #: Where the keys of each document, and of what repeats its text, begin.
    copy: np.ndarray
    terms: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    docs: np.ndarray
    weight: np.ndarray
    bound: np.ndarray
    row: np.ndarray
    long: np.ndarray
    most: np.ndarray
    pair: np.ndarray
    block: np.ndarray
    start: np.ndarray
    #: The block of each document.
    of: np.ndarray
    seen: Seen = field(default_factory=Seen)

    @staticmethod
    def load(row: dict, mean: float) -> Shard:
        """From n and the buffers of the other columns of INDEX."""
        n, get = row["n"], lambda c, t: np.frombuffer(row[c], t)
        length, terms = get("lengths", "<i4").astype(float), get("terms", "<u8")
        size = _unpacked(row["df"], len(terms)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        docs, tf = _unpacked(row["docs"], int(begin[-1])), _unpacked(row["tf"], int(begin[-1])).astype(float)
        weight = (K1 * (1 - B + B * length / max(mean, 1e-9)))[docs]
        weight += tf
        tf *= K1 + 1
        np.divide(tf, weight, out=weight)
        del tf
        # Places where another list, or another block of a list, begins.
        block = docs // BLOCK
        new = np.ones(len(docs), bool)
        new[1:] = block[1:] != block[:-1]
        new[begin[:-1]] = True
        pairs = np.flatnonzero(new).astype(np.int32 if len(docs) < 1 << 31 else np.int64)
        del new
        top = np.maximum.reduceat(weight, pairs) if len(pairs) else np.zeros(0)
        pair = np.searchsorted(pairs, begin).astype(pairs.dtype)
        bound = np.maximum.reduceat(top, pair[:-1]) if len(top) else np.zeros(0)
        heavy = np.flatnonzero(size * LONG > n)
        rows = np.full(len(size), -1)
        rows[heavy] = np.arange(len(heavy))
        long, most = np.zeros((len(heavy), n)), np.zeros((len(heavy), -(-n // BLOCK)))
        for i, k in enumerate(heavy.tolist()):
            long[i, docs[begin[k] : begin[k + 1]]] = weight[begin[k] : begin[k + 1]]
            most[i, block[pairs[pair[k] : pair[k + 1]]]] = top[pair[k] : pair[k + 1]]
        copy = np.concatenate([[0], np.cumsum(get("copies", "<i4"), dtype=np.int64)])
        return Shard(n, get("keys", "<i8"), get("known", np.uint8) > 0, copy, terms, begin, size, docs, weight, bound, rows, long, most, pair, block[pairs], np.append(pairs, pairs.dtype.type(len(docs))), np.arange(n) // BLOCK)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The list of each term, -1 where there is none."""
        at = np.searchsorted(self.terms, terms)
        there = self.terms[np.minimum(at, len(self.terms) - 1)] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return np.where(there, at, -1)

    def search(self, at: np.ndarray, weights: np.ndarray, k: int, best: tuple, least: float = 0.0) -> tuple:
        """search_all() of one query."""
        return self.search_all([(at, weights)], k, [best], [least])[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, best: list[tuple], least: Sequence[float]) -> list[tuple]:
        """(scores, keys, known) of each query's best k of what is here and what `best` already has; scores below `least` may be left out.

        queries: the places of a query's terms, as places() tells them, and their weights. Bounds of blocks and long lists that are walked are products for all of them at once.
        """
        ready, walk, before = [], np.zeros((len(queries), len(self.long))), np.zeros((len(queries), len(self.long)))
        for i, (at, weights) in enumerate(queries):
            there = at >= 0
            at, weights = at[there], weights[there]
            row, size = self.row[at], self.size[at]
            self.seen.postings += int(size.sum())
            heavy = row >= 0
            short, w_short = at[~heavy], weights[~heavy]
            # The pivot: long lists from it on are added whole, those before it together stay below a share of the threshold.
            order = np.flatnonzero(heavy)
            order = order[np.argsort(-size[order], kind="stable")]
            reach = max(least[i], best[i][0][-1] - SAME if len(best[i][0]) == k else 0.0)
            pivot = int(np.searchsorted(np.cumsum(weights[order] * self.bound[at[order]]) * ROUND, PIVOT * reach))
            before[i, row[order[:pivot]]] = weights[order[:pivot]]
            walk[i, row[order[pivot:]]] = weights[order[pivot:]]
            ready.append((row[order], weights[order], size[order], pivot, short, w_short, reach))
        # Bounds of the long lists in each block, of those before the pivot and of all; of the short ones together.
        below = before @ self.most * ROUND
        above = walk @ self.most * ROUND
        walked = walk @ self.long
        return [self._one(*q, below[i], above[i], walked[i], k, best[i], least[i]) if len(q[0]) or len(q[4]) else best[i] for i, q in enumerate(ready)]

    def _one(self, row: np.ndarray, weights: np.ndarray, size: np.ndarray, pivot: int, short: np.ndarray, w_short: np.ndarray, reach: float, below: np.ndarray, above: np.ndarray, walked: np.ndarray, k: int, best: tuple, least: float) -> tuple:
        """A query of search_all(): its long lists, the most frequent first, the first `pivot` of which aren't walked, and its short ones."""
        self.seen.blocks += len(below)
        open_ = below + above + float(w_short @ self.bound[short]) * ROUND >= reach
        if not open_.any():
            return best
        # Short lists are walked, but for blocks that are out of reach already.
        begin, end, w = self.begin[short], self.begin[short + 1], w_short
        if 2 * open_.sum() < len(open_):
            first, last = self.pair[short], self.pair[short + 1]
            p, w = spread(first, last), np.repeat(w_short, last - first)
            own = open_[self.block[p]]
            begin, end, w = self.start[p[own]], self.start[p[own] + 1], w[own]
        score = walked
        posts = spread(begin, end)
        if len(posts):
            weight = self.weight.take(posts)
            weight *= np.repeat(w, end - begin)
            score = score + np.bincount(self.docs.take(posts), weight, self.n)
        self.seen.walked += len(posts) + int(size[pivot:].sum())
        block = self.of
        hope = score * ROUND
        if pivot:
            hope += np.repeat(below, BLOCK)[: self.n]
        left = hope > 0
        if not open_.all():
            left &= open_[block]
        for some in (4 * k, self.n):
            # Of many documents the most promising first: their scores raise the threshold for the rest.
            own = np.flatnonzero(left & (hope >= reach))
            if not len(own):
                break
            if len(own) > max(MANY, some):
                own = own[np.argpartition(-hope[own], some)[:some]]
            left[own] = False
            self.seen.blocks_scored += int((np.bincount(block[own], minlength=1) > 0).sum())
            got = score[own]
            if pivot:
                # Bounds of the first lists in the blocks of these documents, added up one list after the other.
                at = block[own]
                upto = np.cumsum(weights[:pivot, None] * self.most[row[:pivot]], axis=0) * ROUND if pivot > LOOK else None
            for z in range(pivot, 0, -LOOK):
                if not len(own):
                    break
                # From the pivot backwards, until the lists that are left can't lift a document to the threshold any more.
                a = max(0, z - LOOK)
                got = got + weights[a:z] @ self.long[row[a:z, None], own[None, :]]
                self.seen.looked_up += (z - a) * len(own)
                if a:
                    keep = got * ROUND + upto[a - 1][at] >= reach
                    own, got, at = own[keep], got[keep], at[keep]
            got = np.round(got, DIGITS)
            hit = (got > 0) & (got >= reach)
            best = merge(best, self.named(own[hit], got[hit], k), k)
            reach = max(least, best[0][-1] - SAME if len(best[0]) == k else 0.0)
        return best

    def named(self, own: np.ndarray, score: np.ndarray, k: int) -> tuple:
        """(scores, keys, known) of documents; of those with one text the first k keys."""
        first = self.copy[own]
        n = np.minimum(self.copy[own + 1] - first, k)
        at = spread(first, first + n)
        return np.repeat(score, n), self.keys[at], self.known[at]


NONE = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))


def merge(a: tuple, b: tuple, k: int) -> tuple:
    """The best k of two lists of (scores, keys, known); equal scores by key, unknown keys last."""
    score, key, known = (np.concatenate([x, y]) for x, y in zip(a, b))
    if len(score) > k:
        cut = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, key, known = score[cut], key[cut], known[cut]
    order = np.lexsort((key, ~known, -score))[:k]
    return score[order], key[order], known[order]


def weigh(queries: DataFrame, index: Index, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (query, terms, weights, n) of each distinct text, weights are counts in it times idf; (query, asked, q), the rows of queries that have it, numbered, and their keys."""

    def run(batches):
        words = Hasher()
        for b in batches:
            for row, t in zip(*[b.column(i).to_pylist() for i in range(2)]):
                h, c, _ = _terms(words, t)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["query", "h", "c"])

    read = queries.select(F.monotonically_increasing_id().alias("asked"), F.col(f"`{key}`").cast("long").alias("q"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("t"))
    texts = materialize(read.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("asked").alias("query"), F.first("t").alias("t"), F.collect_list(F.struct("asked", "q")).alias("rows")), "query-texts")
    each = materialize(texts.select("query", "t").mapInArrow(run, "query long, h long, c long"), "query-terms")
    idf = F.log1p((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pairs = each.join(index.frequencies, "h").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("h", (F.col("c") * idf).alias("w")))).alias("p"))
    ready = materialize(pairs.select("query", F.col("p.h").alias("terms"), F.col("p.w").alias("weights"), F.size("p").alias("n")), "queries")
    return ready, texts.select("query", F.inline("rows"))


HIT = "array<struct<s:double,u:boolean,k:long>>"


def _best_of(batches, query: tuple, mean: float, k: int) -> list[tuple]:
    """Each query's best k in shards that come one after the other: of two shards one is gone before the next is loaded."""
    _, at, vocabulary, term, weights, least = query
    names, best = [c.split()[0] for c in INDEX.split(", ")][1:], [NONE] * len(least)
    for b in batches:
        for i in range(b.num_rows):
            shard = Shard.load({c: b.column(j)[i].as_py() if c == "n" else b.column(j)[i].as_buffer() for j, c in enumerate(names)}, mean)
            place = shard.places(vocabulary)
            for a in range(0, len(best), TOGETHER):
                some = [(place[term[at[q] : at[q + 1]]], weights[at[q] : at[q + 1]]) for q in range(a, min(a + TOGETHER, len(best)))]
                best[a : a + TOGETHER] = shard.search_all(some, k, best[a : a + TOGETHER], least[a : a + TOGETHER])
            del shard
        # The batch too, and what Arrow keeps of it.
        del b
        pa.default_memory_pool().release_unused()
    return best


def _search(shards: DataFrame, mean: float, sent, k: int) -> DataFrame:
    """(query, hits) from these shards: a query's best k of each task."""

    def run(batches):
        forget()
        one_thread()
        queries = sent.value[0]
        best = _best_of(batches, sent.value, mean, k)
        kind = pa.list_(pa.struct([("s", pa.float64()), ("u", pa.bool_()), ("k", pa.int64())]))
        for i in range(0, len(queries), 512):
            own = [j for j in range(i, min(i + 512, len(queries))) if len(best[j][0])]
            hits = [[{"s": -s, "u": not ok, "k": x} for s, x, ok in zip(*[c.tolist() for c in best[j]])] for j in own]
            yield pa.RecordBatch.from_arrays([pa.array([queries[j] for j in own], pa.int64()), pa.array(hits, kind)], names=["query", "hits"])

    # Lists of k are merged twice, so that none is long however many tasks there were.
    ranked = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
    found = shards.drop("shard").mapInArrow(run, f"query long, hits {HIT}")
    return found.withColumn("p", F.spark_partition_id() % 64).groupBy("query", "p").agg(ranked).groupBy("query").agg(ranked)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "doc_id", query_text: str = "text", max_terms: int = MAX_TERMS, index: Index | None = None) -> DataFrame:
    """(query, query_id, rank, doc_id, score): the k best documents of each row of queries; query_id is its key."""
    if not isinstance(queries.schema[query_key].dataType, T.IntegralType):
        raise ValueError(f"keys are integers: {query_key} is {queries.schema[query_key].dataType.simpleString()}")
    spark = docs.sparkSession
    index = index or build(docs, key, text)
    ready, asked = weigh(queries, index, query_key, query_text)
    n_groups = max(1, -(-ready.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // max_terms))
    parts = []
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    for g in range(n_groups):
        rows = ready.where(F.pmod(F.xxhash64("query"), F.lit(n_groups)) == g).select("query", "terms", "weights", "n").toArrow().combine_chunks()
        flat = lambda c, t: rows.column(c).combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, t)  # noqa: E731, B023
        names = rows.column("query").to_numpy()
        # Terms go out once, and as places among these; a task looks all of them up in a shard together.
        vocabulary, term = np.unique(flat("terms", np.int64).view(np.uint64), return_inverse=True)
        query = names.tolist(), np.cumsum([0, *rows.column("n").to_pylist()]), vocabulary, term.astype(np.int32), flat("weights", float)

        def step(shards: DataFrame, least: np.ndarray, query=query) -> DataFrame:
            sent = spark.sparkContext.broadcast((*query, least))
            with short_batches(spark, 1):  # a row is a whole shard
                found = materialize(_search(shards, index.mean, sent, k), "found")
            sent.destroy()
            return found

        head = step(index.shards.where(first), np.zeros(len(names)))
        full = head.where(F.size("hits") >= k).select("query", (-F.get("hits", F.lit(k - 1))["s"]).alias("s")).toArrow()
        least, place = np.zeros(len(names)), {q: i for i, q in enumerate(names.tolist())}
        for q, s in zip(full.column("query").to_pylist(), full.column("s").to_pylist()):
            least[place[q]] = s - SAME
        parts += [head, step(index.shards.where(~first), least)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    merged = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    named = merged.join(asked, "query").select(F.col("asked").alias("query"), F.col("q").alias("query_id"), F.posexplode("hits").alias("rank", "hit"))
    return named.select("query", "query_id", (F.col("rank") + 1).alias("rank"), F.when(~F.col("hit.u"), F.col("hit.k")).alias("doc_id"), (-F.col("hit.s")).alias("score"))
