"""Suffix-array dedup: removes every byte covered by a string of a given length that starts twice or more in the corpus.

The suffix array is sparse: of every window's suffixes only the one at the window's anchor is
kept, the place with the least hash of 16 bytes. Suffixes are range-partitioned by their
leading bytes with sampled splitters, sorted in buckets by multikey quicksort and compared with
their neighbours, across bucket boundaries where one lead fills several (see anchors.py).

Null text counts as empty; texts shorter than the window lose nothing; equal rows count
as two texts and are removed whole if long enough. Matches never cross rows. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Kind, coverage, ordered, prints, repeated_windows, runs, sliding_minimum, with_runs
from .common import SEED, SLICE, U64, map_batches, mix, ranges, text_slices, window_hashes, words_of_eight

GRAM = 16
#: Texts longer than this are handled in pieces that overlap by a window.
PIECE = 1 << 21
LOW = U64((1 << 24) - 1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of the 16 bytes from each place."""
    eight = words_of_eight(buf)[: len(buf) - GRAM // 2 + 1]
    return mix(mix(eight[:-8]) * SEED[1] + eight[8:])


def byte_kind(window: int) -> Kind:
    def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for row, _, buf, offsets in text_slices(column, SLICE):
            if len(buf) <= PIECE:
                yield row, 0, buf, offsets
            else:
                for at in range(0, len(buf) - window + 1, PIECE):
                    part = buf[at : at + PIECE + window - 1]
                    yield row, at, part, np.array([0, len(part)])

    def records(column: pa.Array) -> Iterator[tuple]:
        for row0, shift, buf, offsets in pieces(column):
            if len(buf) < window:
                continue
            place = np.arange(len(buf) - GRAM + 1, dtype=U64)
            best = sliding_minimum((gram_hashes(buf) & ~LOW) | place, window - GRAM + 1)
            anchor = (best & LOW).astype(np.int64)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
            valid = np.arange(len(best)) + window <= offsets[1:][row]
            lo, hi = runs(anchor, row, valid)
            at, row = anchor[lo], row[lo]
            ends = np.lib.stride_tricks.sliding_window_view(buf, 8)
            lead = [ordered(np.ascontiguousarray(ends[at + k]).view(">u8").ravel().astype(U64)) for k in (0, 8)]
            marks = prints(buf, lo, hi + window, at - lo)
            base = offsets[row] - shift
            yield row + row0, *lead, marks, lo - base, hi - base

    def contexts(buf: np.ndarray, offsets: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        size = (hi - lo + window).astype(np.int64)
        data = buf[ranges(offsets[which] + lo, size)]
        return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

    def hashes(data: np.ndarray, offsets: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
        eight = words_of_eight(data)[: max(0, len(data) - 7)]
        return window_hashes(mix(eight ^ SEED[seed]), window, 8)[ranges(offsets[:-1], count)]

    def contents(offsets: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
        return ranges(offsets[:-1], count), window

    return Kind(window, records, contexts, hashes, contents, by_order=False)


def remove_repeats(docs: DataFrame, window: int = 200, key: str = "doc_id", column: str = "text", as_text: bool = False) -> DataFrame:
    """docs with kept (binary: the remaining bytes), n_bytes, n_removed and spans (array of start, end: maximal removed runs).
    as_text: kept is a string, without what is left of characters that were cut in two."""
    extra = ["kept", "n_bytes", "n_removed", "spans"]
    names = [n for n in docs.columns if n not in extra]
    rows = docs.select(F.struct(*(docs[n] for n in names if n != column)).alias("rest"), F.coalesce(docs[key].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(docs[key], docs[column]).alias("rk"), docs[column].alias("text"))
    kind = byte_kind(window)
    joined = with_runs(rows, repeated_windows(rows, kind)).select("rest", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, buf, offsets in text_slices(batch.column(1)):
                gone = coverage(batch.column(2).slice(row, to - row), offsets, window)
                before = np.concatenate([[0], np.cumsum(gone)])[offsets]
                head, tail = gone.copy(), gone.copy()
                edge = np.zeros(len(gone) + 1, bool)
                edge[offsets] = True
                head[1:] &= ~gone[:-1] | edge[1:-1]
                tail[:-1] &= ~gone[1:] | edge[1:-1]
                s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
                at = np.searchsorted(s, offsets)
                base = np.repeat(offsets[:-1], np.diff(at))
                spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], ["start", "end"]))
                kept = buf[~gone]
                place = (offsets - before).astype(np.int64)
                out = pa.Array.from_buffers(pa.large_binary(), to - row, [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(kept))]).cast(pa.binary())
                if as_text:
                    out = pa.array([x.decode(errors="ignore") for x in out.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row), out, pa.array(np.diff(offsets)), pa.array(np.diff(before)), spans], names=["rest", "text", *extra])

    shape = joined.select("rest", "text", F.lit("" if as_text else b"").alias("kept"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.expr("cast(null as array<struct<start: bigint, end: bigint>>)").alias("spans")).schema
    out = map_batches(joined, run, shape)
    return out.select(*(F.col("text").alias(n) if n == column else F.col("rest")[n].alias(n) for n in names), *extra)
