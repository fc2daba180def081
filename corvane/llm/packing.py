"""Best-fit packing by sums of squares: a document goes where the squared counts of open bins per residual gap become smallest.

Texts become token ids; a text of more than `length` ids is cut into pieces, the last of which may
be shorter. Whole pieces fill a sequence each. The others are dealt by hash (of row and place, so that equal rows part) to groups of about `group` pieces;
each group is packed in a task of its own, the longest piece first, so memory and time of a task are bounded.

Defined results: a null text is empty and has the closing id only; repeated rows are packed like
others; an empty table gives an empty result; columns named like a new one are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, SLICE_ROWS

LENGTH, GROUP = 2048, 100_000
#: Pieces in a group where their ids are carried along: 80 MB at most.
WIDE_GROUP = 10_000
#: Words whose ids a task keeps at hand.
CACHE_WORDS = 600_000

#: Letters of Latin-1 in UTF-8, then what closes them: ASCII marks but the apostrophe, which begins token runs with letters.
WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if WORD.fullmatch(c.encode()) and c.isalpha())
#: Runs on which a tokenizer must answer as the short way does.
PROBES = [LETTERS, LETTERS.lower(), LETTERS[::-1], "Word", "\u00dcber,", "l\u00e9s***", "a...", "don", "s", "\u00dfe(["]


class Words(dict):
    """Little-endian ids for each run of characters without ASCII white space.

    The tokenizer never joins what white space separates, so the ids of a text are those of its
    runs, one after the other. Forgets all runs when there are too many.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, level = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): level.pre_tokenize_str(c)[0][0] for c in LETTERS}
        self.short = True
        self.short = all(self[p.encode()] == self.encode(p.encode()) for p in PROBES)
        self.clear()

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        # Letters are lower-cased and go to the model as they are; what closes them is a token run of its own. All else takes the tokenizer's whole way.
        parts = WORD.fullmatch(run) if self.short else None
        if not parts:
            got = self.encode(run)
        elif parts[2]:
            got = self[parts[1]] + self[parts[2]]
        elif (lower := run.decode().lower()) != run.decode():
            got = self[lower.encode()]
        else:
            got = np.array([t.id for t in self.model.tokenize(lower.translate(self.shown))], "<u4").tobytes()
        if len(run) < 100:
            self[run] = got
        return got

    def encode(self, run: bytes) -> bytes:
        return np.array(self.tokenizer.encode(run.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


@lru_cache(1)
def worker_words(path: str) -> Words:
    """One for all tasks of a Python worker, until another operator runs there."""
    return Words(path)


KEPT.append(worker_words.cache_clear)


def tokenize(docs: DataFrame, path: str, text: str = "text", length: int = LENGTH, close: int = 0) -> DataFrame:
    """One row for each piece: the columns of `docs` but the text, piece, start, length, ids (binary: unsigned 32-bit, little-endian)."""
    new = ["piece", "start", "length", "ids"]
    keep = [c for c in docs.columns if c not in (*new, text)]
    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__bytes"))
    schema = T.StructType([*[read.schema[c] for c in keep], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        words, end = worker_words(path), np.array([close], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                row, piece, start, ids = [], [], [], []
                for i, t in enumerate(b.column(len(keep)).to_pylist()):
                    all_ids = words.ids(t) + end
                    for k in range(0, len(all_ids), 4 * length):
                        row.append(i)
                        piece.append(k // (4 * length))
                        start.append(k // 4)
                        ids.append(all_ids[k : k + 4 * length])
                kept = b.select(list(range(len(keep)))).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, *new])

    return read.mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given: the bin whose choice leaves the least sum of squared counts of open bins over gaps.

    With n[g] open bins of gap g, moving one from g to g - s changes the sum by 2 (n[g - s] - n[g] + 1);
    a new bin by 2 n[capacity - s] + 1; gap 0 is closed and counts nothing. Of equal choices the smallest gap is taken.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    far = 4 * (len(sizes) + 1)
    for k, s in enumerate(sizes.tolist()):
        change = np.where(n[s:capacity] > 0, 2 * (n[: capacity - s] - n[s:capacity] + 1), far)
        if len(change) and n[s] > 0:
            change[0] = -2 * n[s] + 1
        new = 2 * n[capacity - s] + 1 if s < capacity else 0
        g = s + int(change.argmin()) if len(change) else capacity
        if g < capacity and n[g] > 0 and change[g - s] <= new:
            at = open_[g].pop()
            n[g] -= 1
        else:
            g, at = capacity, made
            made += 1
        bins[k], offsets[k] = at, capacity - g
        if g > s:
            open_[g - s].append(at)
            n[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = LENGTH, group: int | None = None, size: str = "length") -> DataFrame:
    """`pieces` with sequence_id and offset. No sequence has more than `capacity` tokens, and none has a gap.

    Reads `pieces` more than once: they should be cheap to read (a written table).
    """
    group = group or (WIDE_GROUP if "ids" in pieces.columns else GROUP)
    kept = pieces.drop("sequence_id", "offset")
    short = kept.where(F.col(size) < capacity)
    n_groups = max(1, round(short.count() / group))
    names = kept.columns

    def together(table: pa.Table) -> pa.Table:
        sizes = table.column(size).to_numpy()
        order = np.lexsort((np.arange(len(sizes)), -sizes))
        bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        bins[order], offsets[order] = sum_of_squares(sizes[order], capacity)
        number = table.column("__group").to_numpy().astype(np.int64) * (1 << 32) + bins
        return table.drop_columns("__group").append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = short.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *[F.col(f"`{c}`") for c in names if c != "ids"]), F.lit(n_groups)).cast("int")) if n_groups > 1 else short.withColumn("__group", F.lit(0))
    packed = dealt.groupBy("__group").applyInArrow(together, schema)
    # Numbers of whole pieces are below 0: they meet no other.
    whole = kept.where(F.col(size) >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)
