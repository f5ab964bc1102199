"""Shared pieces of the training-data operators: words and hashes over whole Arrow buffers, shared folders.

Text is handled as UTF-8 bytes in numpy arrays, a bounded slice at a time, so that no
Python code runs per byte or per word and a worker's memory does not depend on the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..plans.runtime import shared_folder

#: Bytes of text that are turned into arrays at once.
SLICE = 1 << 19
#: Word separators: the characters outside `[^\x20\x09-\x0D]`.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same separators as a pattern for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values (the splitmix64 steps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


SEED = randoms(4, 2)
#: Slices longer than this are hashed one by one.
LONG_SLICE = 64
#: Of a word of eight bytes the first k, for k = 0 to 8.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def words_of_eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf as one value; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buf) + 1,), (1,))


def slice_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand. Slices of seven bytes or less never share one
    among themselves; longer ones are chained through a non-linear step, those beyond LONG_SLICE go through xxh3."""
    size = end - start
    eight = words_of_eight(buf)
    out = mix((eight[start] & FIRST[np.minimum(size, 7)]) + (np.minimum(size, 8).astype(U64) << U64(56)) + U64(int(SEED[0]) * seed % (1 << 64)))
    at = np.flatnonzero((size > 7) & (size <= LONG_SLICE))
    place, left = start[at] + 7, size[at] - 7
    while len(at):
        out[at] = mix((out[at] ^ (eight[place] & FIRST[np.minimum(left, 8)])) * SEED[1] + left.astype(U64))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    at = np.flatnonzero(size > LONG_SLICE)
    if len(at):
        view, digest = memoryview(np.ascontiguousarray(buf)), xxhash.xxh3_64_intdigest
        out[at] = [digest(view[a:b], seed) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
    return out


def window_hashes(x: np.ndarray, width: int, span: int = 1) -> np.ndarray:
    """Hashes of x[i : i + width] for each i that has so many, by doubling: x holds hashes of the span units from each place. Every step is
    non-linear, so no pattern of units cancels."""
    n = len(x) - (width - span)
    if n <= 0:
        return x[:0]
    while span * 2 <= width:
        x = mix(x[:-span] * SEED[2] + mix(x[span:]))
        span *= 2
    return x[:n] if span == width else mix(x[:n] * SEED[3] + mix(x[width - span : width - span + n]))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row (offsets delimit rows) the number of words before it."""
    inside = ~SEPARATOR[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets of rows in them) for consecutive rows of about limit bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None and len(column) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated start[i], start[i] + 1, ... of the given lengths."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)


def materialised(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: later jobs neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = shared_folder(spark)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


_tidied = 0.0


def tidy(spark: SparkSession, every: float = 5.0) -> None:
    """Lets the driver's JVM collect what nothing refers to any more, once in so many seconds: with it Spark removes shuffle files and broadcasts of earlier
    rounds from executors, which would else stay for as long as the driver's heap has room."""
    global _tidied
    if time.monotonic() - _tidied > every:
        spark._jvm.System.gc()
        release()
        _tidied = time.monotonic()


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers are kept for later tasks, beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable, schema) -> DataFrame:
    """mapInArrow with a function from batches to batches, after which the worker's free memory is released."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers of some MB, unless the session says otherwise: they are held by the executor and by the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64MB", "64m", "67108864", "67108864b", "268435456", "268435456b", "256MB"):
        spark.conf.set(name, "4m")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a long, b long); component is the smallest node reachable."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), ordered=False).withColumnRenamed("id", "node")
