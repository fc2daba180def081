"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c has level 1 + floor(log(c) / log(base)); an n-gram is put into the filter once for each level up to
its own, and its level is found again by probing level after level until one is missing. Words, pairs and triples are all kept; where
a caller sets `least`, only pairs and triples that occur so often (their levels begin with that of `least`). The
model interpolates triples with pairs and pairs with words: p3 = (c(abc) + prior p2) / (c(ab) + prior), and so on.

The filter is made of segments, one for about so many bytes of text, so that it grows with what was read at an
unchanged error rate. Up to `max_bytes` of segments are broadcast to the tasks that score. Beyond, the distinct n-grams of
each slice of texts are sent to the segment that holds them, probed there, and their levels sent back: each text
is then read and shuffled once more, however many segments there are. Where texts are learned from and scored at once, one shuffle
brings their n-grams both to be counted and to be looked up, as compressed differences of ascending keys.

Tasks add counts up over TOKENS tokens, and send one row a segment, not one an n-gram. Exact word counts come
out of the same shuffle for the base score: the commonest words, at most `head`, are broadcast, the counts of the others
are joined; no word outside the head is frequent.

Words are told apart by 64-bit XXH64, pairs and triples by 48 bits within their segment. Defined results: a null text is
empty and has one token (the end); a null key is in no held-out part; repeated rows are scored alike; with no
training text every count is 0; columns named like a new one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import SLICE_ROWS, add_columns, forget, remainder, short_batches

#: Hashes of the marks for the begin and end of a text (fixed values).
BEGIN, END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Words whose hash a task keeps at hand; tokens whose counts it adds up before it sends them.
CACHE_WORDS, TOKENS = 100_000, 2_000_000
#: Bytes of text in a slice, where n-grams are sent to their segments.
SLICE_BYTES = 4_000_000


@dataclass(frozen=True)
class Settings:
    """base: of the levels; bits: of the filter for each entry; probes: bits set for an entry; segment: bytes of text for each
    segment; least: pairs and triples that occur less often aren't kept; prior: occurrences that the shorter n-gram's estimate
    counts for; head: most words with broadcast counts; max_bytes: of segments that are broadcast."""

    base: float = 1.5
    bits: int = 12
    probes: int = 5
    segment: int = 6_000_000
    least: int = 1
    prior: float = 2.0
    head: int = 1_000_000
    max_bytes: int = 160_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def keys(h: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit keys of each token, of the pair and of the triple that end with it; `firsts` are the places where texts begin.

    The first token's pair has the begin before it; it has no triple: the key in its place is that of the pair.
    """
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[firsts] = np.uint64(BEGIN)
    pair = mix(before * np.uint64(0x9FB21C651E98DF25) + h)
    triple = np.empty_like(h)
    triple[1:] = mix(pair[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    triple[firsts] = pair[firsts]
    cut = np.uint64(16)
    return h >> cut, pair >> cut, triple >> cut


def segment_of(key: np.ndarray, n: int) -> np.ndarray:
    """The segment of each 48-bit key: segments are equal ranges of keys, in order."""
    return (((key >> np.uint64(16)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def thin(key: np.ndarray) -> np.ndarray:
    """48-bit keys as six bytes each."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def wide(raw: bytes) -> np.ndarray:
    got = np.zeros((len(raw) // 6, 8), np.uint8)
    got[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return got.reshape(-1).view("<u8")


class Hasher(dict):
    """Eight bytes for each word; forgets all words when there are too many."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        return got

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        """The same as integers, without a look at those that are known: hashing a word takes less time than finding it among very many."""
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of all texts, one after the other, each closed by the end; the lengths."""
        end = END.to_bytes(8, "little")
        parts = [b"".join(map(self.__getitem__, (t or b"").lower().split())) + end for t in texts]
        return np.frombuffer(b"".join(parts), "<u8"), np.fromiter((len(p) // 8 for p in parts), np.int64, len(parts))


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9)).astype(np.int64)


def stands_for(base: float) -> np.ndarray:
    """The count that each level stands for: the mean of the integers with that level; 0 for level 0."""
    table = [0.0]
    for j in range(1, 256):
        low, high = math.ceil(base ** (j - 1) - 1e-9), math.ceil(base**j - 1e-9) - 1
        table.append((low + max(high, low)) / 2)
    return np.array(table)


def _entry(h: np.ndarray, level: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry goes (to be taken modulo the words of its segment) and the bits that it sets there."""
    x = mix(h + np.uint64(level * 0x2545F4914F6CDD1D % 2**64))
    mask = np.zeros(len(x), np.uint64)
    for i in range(probes):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return mix(x) >> np.uint64(16), mask


def fill(key: np.ndarray, level: np.ndarray, s: Settings) -> np.ndarray:
    """A segment: 64-bit words with the entries of these n-grams, one for each level from 1 to the n-gram's."""
    words = np.zeros(max(1, -(-int(level.sum()) * s.bits // 64)), np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        at, mask = _entry(key[level >= j], j, s.probes)
        np.bitwise_or.at(words, (at % np.uint64(len(words))).astype(np.int64), mask)
    return words


def release() -> None:
    """Give back what Arrow keeps of freed buffers: workers outlive their tasks, and the next one brings a filter."""
    pa.default_memory_pool().release_unused()


class Filter:
    """Some of the segments of a filter."""

    def __init__(self, segments: pa.Table, total: int, probes: int):
        self.total, self.probes = max(total, 1), probes
        # The segments that are here only: a task of one segment holds nothing that grows with their number.
        self.numbers = self.size = self.at = np.zeros(0, np.int64)
        chunks = segments.column("words").chunks
        self.words = np.zeros(0, np.uint64)
        if chunks:
            # The words of one chunk lie together in its buffer: they are seen there, not copied.
            own = chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)
            _, offsets, data = own.buffers()
            long = pa.types.is_large_binary(own.type)
            ends = np.frombuffer(offsets, "<i8" if long else "<i4")[own.offset : own.offset + len(own) + 1].astype(np.int64)
            self.words = np.frombuffer(data, "<u8", int(ends[-1] - ends[0]) // 8, int(ends[0])) if ends[-1] > ends[0] else self.words
            numbers = segments.column("segment").to_numpy()
            order = np.argsort(numbers)
            self.numbers = numbers[order].astype(np.int64)
            self.size, self.at = (np.diff(ends) // 8)[order].astype(np.uint64), ((ends[:-1] - ends[0]) // 8)[order].astype(np.uint64)

    def level(self, key: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by repeated probes; 0 for what isn't in these segments."""
        got = np.zeros(len(key), np.uint8)
        if not len(self.words):
            return got
        number = segment_of(key, self.total)
        segment = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        own = np.flatnonzero((self.numbers[segment] == number) & (self.size[segment] > 0))
        for j in range(1, 256):
            if not len(own):
                break
            k = segment[own]
            at, mask = _entry(key[own], j, self.probes)
            hit = self.words[(self.at[k] + at % self.size[k]).astype(np.int64)] & mask == mask
            own = own[hit]
            got[own] = j
        return got


@dataclass
class Model:
    """What training leaves: n_segments and the written segments, (h, c) of all words, totals; size: bytes of the segments."""

    settings: Settings
    n_segments: int
    segments: DataFrame
    counts: DataFrame
    tokens: int
    distinct: int
    texts: int
    size: int


COUNTED = "segment int, h binary, hc binary, g binary, gc binary"


def _counted(train: DataFrame, text: str, n_segments: int) -> DataFrame:
    """Rows of COUNTED: hashes (h) and 48-bit keys of pairs and triples (g) that go to a segment, with their counts (hc, gc)."""
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def send(hs: list[np.ndarray], gs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, uc = np.unique(np.concatenate(hs), return_counts=True)
        g, gc = np.unique(np.concatenate(gs), return_counts=True)
        us, gseg = segment_of(u >> np.uint64(16), n_segments), segment_of(g, n_segments)
        own = np.union1d(us, gseg)
        a, b = np.append(np.searchsorted(us, own), len(u)), np.append(np.searchsorted(gseg, own), len(g))
        uc, gc = uc.astype("<u4"), gc.astype("<u4")
        for i in range(0, len(own), 256):
            part = range(i, min(i + 256, len(own)))
            cut = lambda x, at: [x[at[k] : at[k + 1]].tobytes() for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(own[part.start : part.stop], pa.int32()), *[pa.array(v, pa.binary()) for v in (cut(u, a), cut(uc, a), [thin(g[b[k] : b[k + 1]]).tobytes() for k in part], cut(gc, b))]], names=names)

    def run(batches):
        words, hs, gs, held = Hasher(), [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                h, n = words.tokens(whole.slice(at, SLICE_ROWS).column(0).to_pylist())
                if len(h):
                    firsts = np.cumsum(n) - n
                    _, pair, triple = keys(h, firsts)
                    hs.append(h)
                    gs += [pair, np.delete(triple, firsts)]
                    held += len(h)
                if held >= TOKENS:
                    yield from send(hs, gs)
                    hs, gs, held = [], [], 0
        if hs:
            yield from send(hs, gs)
        release()

    return train.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, COUNTED)


def train(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """Count all n-grams of all texts, and build the filter's segments, each in a task of its own."""
    s = settings
    texts, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()
    n_segments = max(1, -(-size // s.segment))
    first = int(levels(np.array([s.least]), s.base)[0]) - 1

    def sums(group: pa.Table, of: str, counts: str, read) -> tuple[np.ndarray, np.ndarray]:
        value = np.concatenate([read(x) for x in group.column(of).to_pylist()])
        u, at = np.unique(value, return_inverse=True)
        c = np.concatenate([np.frombuffer(x, "<u4") for x in group.column(counts).to_pylist()])
        return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    def build(group: pa.Table) -> pa.Table:
        h, hc = sums(group, "h", "hc", lambda x: np.frombuffer(x, "<u8"))
        g, gc = sums(group, "g", "gc", wide)
        often = gc >= s.least
        words = fill(np.concatenate([h >> np.uint64(16), g[often]]), np.concatenate([levels(hc, s.base), levels(gc[often], s.base) - first]), s)
        built = pa.table({"segment": group.column("segment")[:1].cast(pa.int32()), "words": pa.array([words.tobytes()], pa.binary()), "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([hc.tobytes()], pa.binary())})
        del group, g, gc, words
        release()
        return built

    built = materialize(_counted(docs, text, n_segments).groupBy("segment").applyInArrow(build, "segment int, words binary, h binary, c binary"), "segments")

    counts = materialize(built.select("h", "c").mapInArrow(_unpacked, "h long, c long"), "tokens")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = built.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    return Model(s, n_segments, built.select("segment", "words"), counts, tokens, distinct, texts, size)


def _head(model: Model) -> DataFrame:
    """The commonest words, at most `head`: all with a count from some power of 1.1 on, so that nothing is sorted in one task."""
    power = F.floor(F.log("c") / math.log(1.1))
    room, least = model.settings.head, math.inf
    for j, n in sorted(model.counts.groupBy(power.alias("j")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = j
    return model.counts.where(power >= F.lit(float(least)))


class Scorer:
    """Sums over texts from the levels of their n-grams and the exact counts of the commonest words."""

    def __init__(self, model: Model, head: tuple[np.ndarray, np.ndarray]):
        self.s, self.head = model.settings, head
        self.total, self.least, self.texts = float(model.tokens), 0.1 * (model.distinct + 1), float(model.texts)
        self.count = stands_for(self.s.base)
        first = int(levels(np.array([self.s.least]), self.s.base)[0]) - 1
        self.often = np.concatenate([[0.0], self.count[1 + first :]])

    def base(self, c):
        return (c + 0.1) / (self.total + self.least)

    def work(self, h: np.ndarray, n: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> list[list]:
        """n_tokens, known, base and score of each text, and its words outside the head; the levels are those of each token's n-grams."""
        if not len(n):
            return [[], [], [], [], []]
        begins = np.cumsum(n) - n
        one, two, three = self.count[word], self.often[pair], self.often[triple]
        before, context = np.empty_like(one), np.empty_like(two)
        before[1:], context[1:] = one[:-1], two[:-1]
        before[begins], context[begins] = self.texts, 0
        two = np.minimum(two, before)
        three = np.where(context > 0, np.minimum(three, context), 0.0)
        p = self.base(one)
        p = (two + self.s.prior * p) / (before + self.s.prior)
        p = (three + self.s.prior * p) / (context + self.s.prior)
        known, count = self.head
        u, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
        there = (known[at] == u if len(known) else np.zeros(len(u), bool))[back]
        c = np.where(there, count[at][back] if len(known) else 0, 0)
        base = np.where(there, np.log10(self.base(c)), 0.0)
        rest = [h[b : b + k][~there[b : b + k]].view(np.int64).tolist() for b, k in zip(begins.tolist(), n.tolist())]
        sums = lambda x: np.add.reduceat(x, begins).tolist()
        return [n.tolist(), sums(there.astype(np.int64)), sums(base), sums(np.log10(p)), rest]


_LONG, _DOUBLE = T.LongType(), T.DoubleType()
SUMS = [T.StructField("n_tokens", _LONG), T.StructField("__known", _LONG), T.StructField("__base", _DOUBLE), T.StructField("score", _DOUBLE), T.StructField("__rest", T.ArrayType(_LONG))]


def _numbered(done: DataFrame) -> DataFrame:
    """Numbers to join on, which are written with the rows: the table is read twice."""
    return done.withColumn("__row", F.monotonically_increasing_id())


def _by_broadcast(docs: DataFrame, model: Model, scorer: Scorer, head) -> DataFrame:
    """Sums of each text, all segments being sent to the tasks."""
    # As one chunk, which all tasks of a worker read where it lies.
    sent = docs.sparkSession.sparkContext.broadcast(model.segments.toArrow().combine_chunks())
    total, probes = model.n_segments, model.settings.probes

    def make():
        release()
        words, f = Hasher(), Filter(sent.value, total, probes)
        scorer.head = head.value

        def work(texts):
            h, n = words.tokens(texts)
            k, back = np.unique(np.concatenate(keys(h, np.cumsum(n) - n)), return_inverse=True)
            return scorer.work(h, n, *f.level(k)[back].reshape(3, -1))

        return work

    with short_batches(docs.sparkSession):
        done = materialize(_numbered(add_columns(docs, ["__bytes"], SUMS, make, drop=("__bytes",), rows=SLICE_ROWS // 4)), "scored")
    sent.destroy()
    return done


def _by_shuffle(docs: DataFrame, model: Model, scorer: Scorer, head) -> DataFrame:
    """The same, the distinct n-grams of each slice of texts being sent to the segments that hold them, and their levels back.

    A segment gets each n-gram once a slice at most, and its share of all n-grams stays about the same however large the corpus is.
    """
    total, probes, spark = model.n_segments, model.settings.probes, docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("__bytes")), F.lit(0))).first()[0]
    n_slices = max(spark.sparkContext.defaultParallelism, -(-size // SLICE_BYTES))
    sliced = materialize(docs.withColumn("__slice", F.floor(F.rand(7) * n_slices)), "slices")

    def ask(group: pa.Table) -> pa.Table:
        words = Hasher()
        h, n = words.tokens(group.column("__bytes").to_pylist())
        k = np.unique(np.concatenate(keys(h, np.cumsum(n) - n)))
        seg = segment_of(k, total)
        own = np.unique(seg)
        at = np.append(np.searchsorted(seg, own), len(k))
        return pa.table({"__slice": pa.array(np.full(len(own), group.column("__slice")[0].as_py())), "segment": pa.array(own, pa.int32()), "k": pa.array([thin(k[a:z]).tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())})

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        f = Filter(segment.combine_chunks(), total, probes)
        found = [f.level(wide(k)).tobytes() for k in asked.column("k").to_pylist()]
        return pa.table({"__slice": asked.column("__slice"), "segment": asked.column("segment"), "l": pa.array(found, pa.binary())})

    asked = sliced.select("__slice", "__bytes").groupBy("__slice").applyInArrow(ask, "__slice long, segment int, k binary")
    level = materialize(asked.groupBy("segment").cogroup(model.segments.groupBy("segment")).applyInArrow(answer, "__slice long, segment int, l binary"), "levels")
    keep = [c for c in sliced.columns if c not in ("__slice", "__bytes")]

    def score_(texts: pa.Table, found: pa.Table) -> pa.Table:
        scorer.head = head.value
        h, n = Hasher().tokens(texts.column("__bytes").to_pylist())
        _, back = np.unique(np.concatenate(keys(h, np.cumsum(n) - n)), return_inverse=True)
        found = found.sort_by("segment")
        every = np.frombuffer(b"".join(found.column("l").to_pylist()), np.uint8)
        got = scorer.work(h, n, *every[back].reshape(3, -1))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table([*[texts.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(got, kinds)]], names=[*keep, *[f.name for f in SUMS]])

    schema = T.StructType([*[sliced.schema[c] for c in keep], *SUMS])
    return materialize(_numbered(sliced.groupBy("__slice").cogroup(level.groupBy("__slice")).applyInArrow(score_, schema)), "scored")


def coded(values: np.ndarray) -> bytes:
    """Ascending 64-bit integers in few bytes: their differences, as planes of bytes from the lowest on, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def decoded(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _small(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _large(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.zeros(0, kind) if not n else np.frombuffer(pa.decompress(raw, decompressed_size=np.dtype(kind).itemsize * n, codec="zstd", asbytes=True), kind)


def _packed(docs: DataFrame) -> DataFrame:
    """(slice, rows): written slices of about SLICE_BYTES of text, each whole in one row, compressed. A longer text is a slice of its own."""

    def run(batches):
        forget()
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def slice_():
            out = pa.BufferOutputStream()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["slice", "rows"])

        for whole in batches:
            sizes, first = pc.fill_null(pc.binary_length(whole.column("__bytes")), 0).to_pylist(), 0
            for k, n in enumerate(sizes):
                if size and size + n > SLICE_BYTES:
                    held += [whole.slice(first, k - first)] if k > first else []
                    yield slice_()
                    number, held, size, first = number + 1, [], 0, k
                # Rows without text count too, so that very many of them aren't one slice.
                size += n + 64
            held += [whole.slice(first)] if len(sizes) > first else []
        if held:
            yield slice_()
        release()

    with short_batches(docs.sparkSession, 64):
        return materialize(docs.mapInArrow(run, "slice long, rows binary"), "slices")


SENT = "segment int, slice long, n int, k binary, c binary, m int, h binary, hc binary"


def _together(docs: DataFrame, settings: Settings, n_segments: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slices, levels, counts) with one shuffle of n-grams: each slice of texts sends its distinct n-grams to their segments, with how often they
    occur in its texts to learn from. A segment adds these up, fills its part of the filter, and probes it for all that the slices sent."""
    s, total = settings, n_segments
    slices = _packed(docs)
    names = [x.split()[0] for x in SENT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def send(batches):
        forget()
        words = Hasher()
        for b in batches:
            for number, raw in zip(b.column("slice").to_pylist(), b.column("rows").to_pylist()):
                table = pa.ipc.open_stream(raw).read_all()
                learn = np.asarray(table.column("__learn").to_pylist(), bool)
                h, n = words.tokens(table.column("__bytes").to_pylist())
                firsts, learned = np.cumsum(n) - n, np.repeat(learn, n)
                one, pair, triple = keys(h, firsts)
                whole = learned.copy()
                whole[firsts] = False  # a first token has no triple
                k, back = np.unique(np.concatenate([one, pair, triple]), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate([learned, learned, whole]), minlength=len(k)).astype(np.int64)
                u, uc = np.unique(h[learned], return_counts=True)
                seg, useg = segment_of(k, total), segment_of(u >> np.uint64(16), total)
                own = np.unique(seg)
                at, uat = np.append(np.searchsorted(seg, own), len(k)), np.append(np.searchsorted(useg, own), len(u))
                for i in range(0, len(own), 256):
                    rows = []
                    for j in range(i, min(i + 256, len(own))):
                        x, y = slice(at[j], at[j + 1]), slice(uat[j], uat[j + 1])
                        rows.append((own[j], number, x.stop - x.start, coded(k[x]), _small(c[x], "<u4"), y.stop - y.start, coded(u[y]), _small(uc[y], "<u4")))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)
        release()

    def answer(sent: pa.Table) -> pa.Table:
        n, m = sent.column("n").to_pylist(), sent.column("m").to_pylist()
        every = lambda f, of, sizes, *more: np.concatenate([f(raw, *more, size) for raw, size in zip(sent.column(of).to_pylist(), sizes)])
        k, back = np.unique(every(decoded, "k", n), return_inverse=True)
        c = np.bincount(back, weights=every(_large, "c", n, "<u4"), minlength=len(k)).astype(np.int64)
        there = c > 0
        own = pa.table({"segment": sent.column("segment")[:1], "words": pa.array([fill(k[there], levels(c[there], s.base), s).tobytes()], pa.binary())})
        level = Filter(own, total, s.probes).level(k)[back]
        h, at = np.unique(every(decoded, "h", m), return_inverse=True)
        hc = np.bincount(at, weights=every(_large, "hc", m, "<u4"), minlength=len(h)).astype(np.int64)
        ends = np.cumsum(n)
        found = [_small(level[z - size : z], "u1") for z, size in zip(ends.tolist(), n)]
        segment = sent.column("segment")[0].as_py()
        built = pa.table({
            "segment": pa.array([segment] * (len(n) + 1), pa.int32()), "slice": pa.array([*sent.column("slice").to_pylist(), None], pa.int64()), "n": pa.array([*n, len(h)], pa.int32()),
            "l": pa.array([*found, None], pa.binary()), "h": pa.array([None] * len(n) + [h.tobytes()], pa.binary()), "c": pa.array([None] * len(n) + [hc.tobytes()], pa.binary())})
        del sent, k, back, level
        release()
        return built

    with short_batches(docs.sparkSession, 4):
        answered = materialize(slices.mapInArrow(send, SENT).groupBy("segment").applyInArrow(answer, "segment int, slice long, n int, l binary, h binary, c binary"), "answers")
    counts = materialize(answered.where("slice IS NULL").select("h", "c").mapInArrow(_unpacked, "h long, c long"), "tokens")
    return slices, answered.where("slice IS NOT NULL").select("segment", "slice", "n", "l"), counts


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, "<i8")), pa.array(np.frombuffer(c, "<i8"))], names=["h", "c"])


def _scored(slices: DataFrame, level: DataFrame, scorer: Scorer, head, kept: T.StructType) -> DataFrame:
    """The sums of each text of each slice, from the levels that its segments sent back."""

    def score_(texts: pa.Table, found: pa.Table) -> pa.Table:
        scorer.head = head.value
        table = pa.ipc.open_stream(texts.column("rows")[0].as_py()).read_all()
        h, n = Hasher().tokens(table.column("__bytes").to_pylist())
        _, back = np.unique(np.concatenate(keys(h, np.cumsum(n) - n)), return_inverse=True)
        found = found.sort_by("segment")
        every = np.concatenate([_large(raw, "u1", k) for raw, k in zip(found.column("l").to_pylist(), found.column("n").to_pylist())])
        got = scorer.work(h, n, *every[back].reshape(3, -1))
        sums = [pa.array(v, k) for v, k in zip(got, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())])]
        return pa.table([*[table.column(c) for c in kept.names], *sums], names=[*kept.names, *[f.name for f in SUMS]])

    schema = T.StructType([*kept.fields, *SUMS])
    return materialize(_numbered(slices.groupBy("slice").cogroup(level.groupBy("slice")).applyInArrow(score_, schema)), "scored")


NEW = ("n_tokens", "n_known", "base_score", "score", "train_tokens")


def _read(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*NEW, text)], F.col(f"`{text}`").cast("binary").alias("__bytes"))


def _finished(model: Model, sums: Callable[[Scorer, Broadcast], DataFrame]) -> DataFrame:
    """What sums() gives for each text, completed by the exact counts of the words outside the head."""
    total, v = float(model.tokens), model.distinct
    top = _head(model).toArrow()
    order = np.argsort(top.column("h").to_numpy().view(np.uint64))
    head = model.counts.sparkSession.sparkContext.broadcast((top.column("h").to_numpy().view(np.uint64)[order].copy(), top.column("c").to_numpy()[order].copy()))
    done = sums(Scorer(model, (np.zeros(0, np.uint64), np.zeros(0, np.int64))), head)
    head.destroy()
    rare = done.select("__row", F.explode("__rest").alias("h")).groupBy("__row", "h").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    found = rare.join(model.counts, "h", "left").groupBy("__row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("__k"), F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(max(total + 0.1 * (v + 1), 0.1)))).alias("__b"))
    out = done.drop("__rest").join(found, "__row", "left").withColumns({"n_known": F.col("__known") + F.coalesce("__k", F.lit(0)), "base_score": F.col("__base") + F.coalesce("__b", F.lit(0.0)), "train_tokens": F.lit(model.tokens).cast("long")})
    return out.drop("__row", "__known", "__base", "__k", "__b")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_tokens, n_known, base_score and score (log10 probabilities), train_tokens.

    base_score: unigrams, add 0.1. score: the model's, all counts from the filter.
    """
    way = _by_broadcast if model.size <= model.settings.max_bytes else _by_shuffle
    return _finished(model, lambda scorer, head: way(_read(docs, text), model, scorer, head))


def score_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", mod: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Train on texts whose key leaves a remainder, score all; held_out: those that leave none.

    Up to a quarter of `max_bytes` of text the filter surely is within it, however short the words are: it is broadcast. Beyond, texts are learned from and scored with one
    shuffle of n-grams (unless some are left out by `least`).
    """
    marked = docs.withColumn("held_out", F.coalesce(remainder(F.col(f"`{key}`"), mod) == 0, F.lit(False)))
    learned = marked.where("NOT held_out")
    size = learned.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    if settings.least > 1 or size <= settings.max_bytes // 4:
        return score(marked, train(learned, text, settings), text)
    n_segments = max(1, -(-size // settings.segment))
    read = _read(marked, text)
    kept = T.StructType([f for f in read.schema.fields if f.name != "__bytes"])
    slices, level, counts = _together(read.withColumn("__learn", ~F.col("held_out")), settings, n_segments)
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = Model(settings, n_segments, level.limit(0), counts, tokens, distinct, learned.count(), 0)
    return _finished(model, lambda scorer, head: _scored(slices, level, scorer, head, kept))
