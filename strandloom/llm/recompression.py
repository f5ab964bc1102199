"""Substring dedup by recompression: removes words of passages that a document with a smaller id has too.

Words are symbols. Rounds shorten a document's sequence of symbols until its windows are used up: a run round names each
run of one symbol, a pair round names each left symbol that a right one follows, where a symbol's own name puts it on the left or
right side, anew in every round. Names are fingerprints of what they stand for, so equal content gets one name wherever it is, and no
round has to send names back. Symbols grow without a limit: what is limited is what a window looks at.

A window of so many words sees of a round's symbols only those whose making depends on nothing outside it: a run
round takes off the runs at its two ends, a pair round a right symbol at its left end and a left symbol at its right
end. What is left, round by round, is a function of the window's words alone, so equal windows have the same interior symbols.
The high-level symbol of a window is the longest of those in its last rounds; of symbols with LONG words or more, and of equally long
ones, the one with the least hash, so that neighbouring windows mostly agree. Every RUNS-th round is a run round.

Then symbols are exchanged (anchors.py): windows of one document in a row with the same symbol are one record under
the symbol's name; names that only one record has reveal that its windows are unique; shared ones are expanded to their windows, which
are compared as records of 128-bit fingerprints of all words they cover, then window by window.

Null text counts as empty; texts with fewer words than a window lose nothing; a row
with a null id comes after all others; rows with one id don't remove each other's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Kind, coverage, prints, repeated_windows, runs, with_runs
from .common import SEED, SLICE, U64, map_batches, mix, randoms, ranges, slice_hashes, text_slices, window_hashes, words

#: Words of a text that are taken as one sequence; longer texts are handled in pieces that overlap by a window.
PIECE = 1 << 18
#: Words from which on a symbol's length no longer counts, symbols that a window sees in a last round at most, distance of run rounds.
LONG, FEW, RUNS = 8, 12, 6
RUN, PAIR = randoms(2, 9) | U64(1)
SIDES = randoms(64, 10)
NONE = ~U64(0)


def run_round(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and heads (whether a row begins there) after naming runs, and the new number of each old symbol."""
    first = head.copy()
    first[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, len(names)))
    out = names[at]
    many = np.flatnonzero(length > 1)
    out[many] = mix(out[many] * RUN + length[many].astype(U64))
    return out, head[at], np.cumsum(first) - 1


def sides(names: np.ndarray, k: int) -> np.ndarray:
    """Whether symbols are right ones in pair round k."""
    return mix(names ^ SIDES[k % len(SIDES)]) >> U64(63) == 1


def pair_round(names: np.ndarray, head: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As run_round: each left symbol is joined with a right one behind it."""
    join = np.flatnonzero(~right[:-1] & right[1:] & ~head[1:])
    out = names.copy()
    out[join] = mix(mix(names[join]) * PAIR + names[join + 1])
    stay = np.ones(len(names), bool)
    stay[join + 1] = False
    return out[stay], head[stay], np.cumsum(stay) - 1


def preference(names: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Less is better: length in words up to LONG, then hash."""
    length = np.minimum(np.diff(place), LONG).astype(U64)
    return (U64(LONG) - length) << U64(56) | mix(names ^ SEED[3]) >> U64(8)


def best_symbol(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol with the least value in each [a, b), the first of equal ones, and that value."""
    best, least = a.copy(), value[a]
    at, live = a + 1, np.flatnonzero(a + 1 < b)
    while len(live):
        x = value[at[live]]
        less = x < least[live]
        best[live[less]], least[live[less]] = at[live[less]], x[less]
        at[live] += 1
        live = live[at[live] < b[live]]
    return best, least


def high_symbols(names: np.ndarray, first: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows that start at the given words: name, first word and number of words of the high-level symbol. names are the
    words' names, first the places where rows begin, with the end."""
    head = np.zeros(len(names) + 1, bool)
    head[first] = True
    head, place = head[:-1], np.arange(len(names) + 1)
    a, b = start.copy(), start + window  # the symbols that a window sees
    which = np.arange(len(start))
    name, at, size, value = np.zeros(len(start), U64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.full(len(start), NONE)
    k = 0
    while len(which):
        if k % RUNS == 0:
            names2, head2, new = run_round(names, head)
            a2, b2 = new[a] + 1, new[b - 1]
        else:
            right = sides(names, k)
            names2, head2, new = pair_round(names, head, right)
            a2, b2 = new[a] + right[a], new[b - 1] + right[b - 1]
        seen = a2 < b2
        look = (b - a <= FEW) | ~seen
        if look.any():
            best, x = best_symbol(preference(names, place), a[look], b[look])
            better = x < value[which[look]]
            w, best = which[look][better], best[better]
            value[w], name[w], at[w], size[w] = x[better], names[best], place[best], place[best + 1] - place[best]
        a, b, which = a2[seen], b2[seen], which[seen]
        place = place[np.append(np.flatnonzero(np.diff(new, prepend=-1)), len(place) - 1)]
        names, head, k = names2, head2, k + 1
    return name, at, size


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = words(buf, offsets)
    return slice_hashes(buf, s, e), first


def word_kind(window: int) -> Kind:
    if window < 3:
        raise ValueError("a window needs three words at least")

    def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for row, _, buf, offsets in text_slices(column, SLICE):
            x, first = word_hashes(buf, offsets)
            if len(x) <= PIECE:
                yield row, 0, x, first
            else:
                for at in range(0, len(x) - window + 1, PIECE):
                    part = x[at : at + PIECE + window - 1]
                    yield row, at, part, np.array([0, len(part)])

    def records(column: pa.Array) -> Iterator[tuple]:
        for row0, shift, x, first in pieces(column):
            n = len(x) - window + 1
            if n <= 0:
                continue
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
            valid = np.arange(n) + window <= first[1:][row]
            start = np.flatnonzero(valid)
            if not len(start):
                continue
            name, at, size = (np.zeros(n, t) for t in (U64, np.int64, np.int64))
            name[start], at[start], size[start] = high_symbols(x, first, start, window)
            lo, hi = runs(at * (window + 1) + size, row, valid)
            row = row[lo]
            marks = prints(x, lo, hi + window, at[lo] - lo)
            base = first[row] - shift
            yield row + row0, name[lo].view(np.int64), size[lo], marks, lo - base, hi - base

    def contexts(buf: np.ndarray, offsets: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        x, first = word_hashes(buf, offsets)
        count = (hi - lo + 1).astype(np.int64)
        place = ranges(first[which] + lo, count)
        data = np.stack([window_hashes(mix(x ^ SEED[k]), window)[place] for k in (0, 1)], 1)
        return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(16 * count)]).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())

    def hashes(data: np.ndarray, offsets: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
        return np.frombuffer(data.tobytes(), U64)[seed::2]

    def contents(offsets: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
        return 16 * np.arange(int(count.sum())), 16

    return Kind(window, records, contexts, hashes, contents, by_order=True)


def remove_shared(docs: DataFrame, window: int = 50, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with kept (string: remaining words joined by a space), n_words and n_removed."""
    extra = ["kept", "n_words", "n_removed"]
    names = [n for n in docs.columns if n not in extra]
    rows = docs.select(F.struct(*(docs[n] for n in names if n != column)).alias("rest"), F.coalesce(docs[key].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(docs[key], docs[column]).alias("rk"), docs[column].alias("text"))
    joined = with_runs(rows, repeated_windows(rows, word_kind(window))).select("rest", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, buf, offsets in text_slices(batch.column(1)):
                s, e, first = words(buf, offsets)
                gone = coverage(batch.column(2).slice(row, to - row), first, window)
                before = np.concatenate([[0], np.cumsum(gone)])[first]
                size = np.where(gone, 0, e - s + 1)
                end = np.cumsum(size)
                data = np.append(buf, np.uint8(0x20))[ranges(s[~gone], size[~gone])]
                data[end[~gone] - 1] = 0x20
                total = np.concatenate([[0], end])[first]
                text = data.tobytes()
                kept = [text[a : b - 1].decode() if b > a else "" for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row), pa.array(kept, pa.string()), pa.array(np.diff(first)), pa.array(np.diff(before))], names=["rest", "text", *extra])

    shape = joined.select("rest", "text", F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    out = map_batches(joined, run, shape)
    return out.select(*(F.col("text").alias(n) if n == column else F.col("rest")[n].alias(n) for n in names), *extra)
