"""What the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of ASCII white space; words are the runs between them.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python function sees at once. Bounds memory where texts are long.
SLICE_ROWS = 256
#: Bytes of text that a Python function sees at once; a longer text comes alone.
SLICE_TEXT = 4 << 20


#: What clears the caches that operators keep in a worker from task to task.
KEPT: list[Callable[[], None]] = []


def forget() -> None:
    """Clear what other operators left in this worker, and give back what Arrow and the C library keep of freed memory: workers outlive their tasks."""
    for clear in KEPT:
        clear()
    pa.default_memory_pool().release_unused()
    # glibc only; elsewhere freed memory stays with the worker.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def one_thread() -> None:
    """Let OpenBLAS use one thread in this worker: a task has one core, and threads that wait for their next product keep other tasks' cores busy."""
    maps = Path("/proc/self/maps")  # elsewhere its threads stay as they are
    for path in {line.split(maxsplit=5)[-1].strip() for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if limit := getattr(ctypes.CDLL(path), name, None):
                limit(1)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What runs within sends at most so many rows at once to Python workers, where these need their memory for a model."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own: the given ones, with underscores added until `df` has none like them."""
    taken, got = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        got.append(name)
    return got


def running(items: Column, zero: Column, add: Callable[[Column, Column], Column], chunk: int = 64) -> Column:
    """Array of {before, item}: each item of an array column with what add() made of all items before it, from `zero`.

    Worked out chunk by chunk, since an array that grows item by item is copied each time. `items` is to be a column, not an expression: it is looked at for each chunk.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / chunk).cast("int")), lambda k: F.slice(items, k * chunk + 1, chunk))
    none = F.array_remove(F.array(zero), zero)
    heads = F.aggregate(chunks, F.struct(zero.alias("at"), none.alias("out")), lambda s, c: F.struct(F.aggregate(c, s["at"], add).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    one = lambda at, x: F.struct(at.alias("before"), x.alias("item"))
    within = lambda c, at: F.aggregate(F.slice(c, 2, chunk), F.struct(add(at, F.get(c, F.lit(0))).alias("at"), F.array(one(at, F.get(c, F.lit(0)))).alias("out")), lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(one(s["at"], x))).alias("out")), lambda s: s["out"])
    return F.when(F.size(items) > 0, F.flatten(F.zip_with(chunks, heads, within)))


def cuts(batch: pa.RecordBatch, columns: list[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Beginnings and lengths of slices of at most so many rows and bytes in the given columns, but of one row at least."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for i in columns:
        x = batch.column(i)
        if pa.types.is_string(x.type) or pa.types.is_binary(x.type) or pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type):
            sizes += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        within = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at
        n = max(1, min(rows, within, batch.num_rows - at))
        yield at, n
        at += n


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list[list]]], drop: tuple[str, ...] = (), rows: int = SLICE_ROWS) -> DataFrame:
    """`df` with more columns, made by Python from the columns `inputs`, at most `rows` rows and SLICE_TEXT bytes of them at a time.

    `make()` runs once in each task and returns a function from lists (one for each input) to lists
    (one for each field). Columns in `drop` are read but not returned. A column of `df` that has the
    name of a new one is replaced.
    """
    new = [f.name for f in fields]
    keep = [c for c in df.columns if c not in new and c not in drop]
    read = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([read.schema[c] for c in keep] + fields)
    n = len(keep)
    kinds = [pa.schema([pa.field("x", _arrow(f.dataType))]).field(0).type for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        work = make()
        for whole in batches:
            for at, size in cuts(whole, list(range(n, n + len(inputs))), rows, SLICE_TEXT):
                b = whole.slice(at, size)
                got = work(*[b.column(n + i).to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(v, type=k) for v, k in zip(got, kinds, strict=True)]], names=[*keep, *new])

    return read.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def words(text: Column) -> Column:
    """Array of the runs without ASCII white space; null and blank texts give an empty array."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo `mod`; null for a null key."""
    return F.crc32(key.cast("string")) % mod
