"""Finding repeated windows of a fixed length without a record for every window.

A window (so many bytes or words) is represented by one anchor: a place in it that its
content alone determines, so equal windows have equal anchors. Consecutive windows with the
same anchor are one record: the anchor's leading content, a fingerprint of all content that
these windows cover, and where they start. Then

1. records are range-partitioned by leading content with sampled splitters, and every bucket
   is sorted locally (multikey quicksort) and compared by neighbours. A key that fills several
   buckets is hot: it is dealt over them by row and compared across the buckets' boundaries
   by pre-aggregated counts,
2. records that agree in lead and in a fingerprint of 128 bits are copies, decided as a whole; a lead that only
   one record has is dropped,
3. records that share a lead but differ around it are cut from the text again and compared
   window by window, within their lead's group: windows are sorted by hash, and each is compared with the first
   of its hash by content; where contents differ, the batch is grouped by content alone. Windows of hot leads are
   rows, pre-aggregated by a hash of 128 bits.

No pairs are made anywhere, and nothing is capped. A row is known by its key and a hash of key and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, map_batches, materialised, mix, shuffle_partitions, small_batches, text_slices

RECORD = "bucket int, lead1 long, lead2 long, print1 long, print2 long, doc long, rk long, lo int, hi int"
TOP = U64(1 << 63)
#: Quantiles are doubles: leads are compared with splitters without the bits that a double lacks.
SHIFT = 11
#: Groups of at most so many rows are ended by numpy's sort.
SMALL = 4096
#: Rows of contexts that are compared at once; whole groups only.
CONTEXTS = 10_000
#: Share of rows from which splitters come, and the accuracy of their quantiles for each bucket.
SPLIT_SAMPLE, SPLIT_ACCURACY = 0.02, 20
#: Tasks over which the rows of one key are dealt where keys are known to be hot.
SALTS = 32


@dataclass(frozen=True)
class Kind:
    """What differs between units. records(column) yields (row, lead1, lead2, prints, lo, hi) of a batch's windows, prints with two
    columns; contexts(text, lo, hi) gives payloads of records; hashes(payload bytes, offsets, numbers of windows, 0 or 1) one of two hashes
    of each window; contents(payload bytes, offsets, numbers of windows) each window's place in those bytes, and the size there."""

    window: int
    records: Callable
    contexts: Callable
    hashes: Callable
    contents: Callable
    #: A window counts as repeated if a smaller doc has it; else if it occurs twice.
    by_order: bool


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned values as signed ones in the same order."""
    return (x ^ TOP).view(np.int64)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many."""
    n, span = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    out = x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def prints(units: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Fingerprints of 128 bits of units[start:end], as two columns."""
    view, digest, k = memoryview(np.ascontiguousarray(units).view(np.uint8)), xxhash.xxh3_128_digest, units.itemsize
    every = b"".join([digest(view[a:b], c) for a, b, c in zip((k * start).tolist(), (k * end).tolist(), seed.tolist(), strict=True)])
    return np.frombuffer(every, np.int64).reshape(-1, 2)


def runs(anchor: np.ndarray, row: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of valid windows with one anchor and row."""
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.concatenate([np.flatnonzero(change | ~valid), [len(anchor)]])
    return first, stop[np.searchsorted(stop, first, "right")] - 1


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """An order of rows by the key words in turn: each step splits rows by a pivot in one word into less, equal
    and greater; equal rows go on with the next word."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort([k[part] for k in keys[depth:][::-1]])]
            continue
        word = keys[depth][part]
        pivot = np.partition(word[:: max(1, len(word) // 63)], 31)[31] if len(word) >= 64 else word[0]
        less, same = word < pivot, word == pivot
        more = ~(less | same)
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        todo += [(lo, lo + a, depth)] if a > 1 else []
        todo += [(lo + a, lo + a + b, depth + 1)] if b > 1 and depth + 1 < len(keys) else []
        todo += [(lo + a + b, hi, depth)] if hi - lo - a - b > 1 else []
    return order


def _records(rows: DataFrame, kind: Kind, splitters: np.ndarray | None) -> DataFrame:
    """rows: doc, rk, text. Without splitters only the leads, for the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, lead1, lead2, marks, lo, hi in kind.records(batch.column(2)):
                if splitters is None:
                    yield pa.RecordBatch.from_arrays([pa.array(lead1 >> SHIFT)], names=["lead1"])
                    continue
                top = lead1 >> SHIFT
                left = np.searchsorted(splitters, top, "left")
                width = np.searchsorted(splitters, top, "right") - left
                spread = (mix(rk[row].view(U64) + lo.astype(U64)) % (width + 1).astype(U64)).astype(np.int64)
                bucket = left + np.where(width > 1, spread, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (bucket.astype(np.int32), lead1, lead2, marks[:, 0], marks[:, 1], doc[row], rk[row], lo.astype(np.int32), hi.astype(np.int32))],
                    names=[x.split()[0] for x in RECORD.split(", ")],
                )

    return map_batches(rows, run, "lead1 long" if splitters is None else RECORD)


GROUPED = "kind int, lead1 long, lead2 long, print1 long, print2 long, doc long, rk long, lo int, hi int, weight int"


def _bucket(kind: Kind, hot: np.ndarray) -> Callable:
    """Compares the records of a bucket: kind 0 has repeated windows, 1 is to be compared by window, 2 has a hot lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if not every:
            return
        _, lead1, lead2, mark1, mark2, doc, rk, lo, hi = (np.concatenate([b.column(i).to_numpy() for b in every]) for i in range(9))
        del every
        burning = np.isin(lead1 >> SHIFT, hot)
        order = multikey_quicksort([lead1, lead2, mark1, mark2, doc]) if len(lead1) else np.zeros(0, np.int64)
        order = order[~burning[order]]
        a, b, c, c2, d = lead1[order], lead2[order], mark1[order], mark2[order], doc[order]
        n = len(order)
        group, same = np.ones(n, bool), np.ones(n, bool)
        group[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        same[1:] = group[1:] | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
        cls, grp = np.cumsum(same) - 1, np.cumsum(group) - 1
        size = np.bincount(cls) if n else np.zeros(0, np.int64)
        first = np.flatnonzero(same)
        many = (np.bincount(grp[first]) > 1)[grp] if n else np.zeros(0, bool)
        if kind.by_order:
            least = d == d[first][cls] if n else many
            covered, open_, weight = ~least, many & least, np.ones(n, np.int64)
        else:
            covered, open_, weight = size[cls] > 1, many & same, np.minimum(size[cls], 2)
        for k, rows, w in ((0, order[covered], None), (1, order[open_], weight[open_]), (2, np.flatnonzero(burning), None)):
            if len(rows):
                zero = np.zeros(len(rows), np.int64)
                keep = [lead1[rows], lead2[rows], mark1[rows], mark2[rows]] if k else [zero] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), k, np.int32)), *(pa.array(x) for x in (*keep, doc[rows], rk[rows], lo[rows], hi[rows])), pa.array((zero if w is None else w).astype(np.int32))],
                    names=[x.split()[0] for x in GROUPED.split(", ")],
                )

    return run


CONTEXT = "lead1 long, lead2 long, doc long, rk long, lo int, hi int, weight int, payload binary"


def _contexts(kind: Kind) -> Callable:
    """Cuts the payloads of a row's open records from its text: (text, list of records, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for row, to, buf, offsets in text_slices(batch.column(0)):
                part = lists.slice(row, to - row)
                flat = part.flatten()
                col = {flat.type.field(i).name: x for i, x in enumerate(flat.flatten())}
                which = np.repeat(np.arange(to - row), np.diff(part.offsets.to_numpy()))
                payload = kind.contexts(buf, offsets, which, col["lo"].to_numpy(), col["hi"].to_numpy())
                yield pa.RecordBatch.from_arrays([*(col[k] for k in ("lead1", "lead2", "doc", "rk", "lo", "hi", "weight")), payload], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return run


def _windows(kind: Kind, table: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the contexts: hash with lead, the context's number, and the place in the row."""
    lead1, lead2, lo, hi = table
    count = hi.astype(np.int64) - lo + 1
    of = np.repeat(np.arange(len(lo)), count)
    lead = mix(lead1.view(U64) ^ mix(lead2.view(U64)))
    return mix(kind.hashes(data, offsets, count, 0) ^ lead[of]), of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8), offsets - offsets[0]


def by_content(names: np.ndarray, first: np.ndarray, which: np.ndarray, data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """which, the number of each window's hash, if windows of one hash have one content, else numbers by content. first: a window of each hash."""
    same = first[which]
    todo = np.flatnonzero(same != np.arange(len(which)))
    # a window that follows another one, as its model does, differs from it in the last byte only where the one before is equal
    step = np.zeros(len(todo), bool)
    if len(todo) > 1:
        p, q = todo[:-1], todo[1:]
        step[1:] = (q == p + 1) & (at[q] == at[p] + 1) & (at[same[q]] == at[same[p]] + 1)
    ok = bool((data[at[todo] + size - 1] == data[at[same[todo]] + size - 1]).all())
    whole, k = todo[~step], max(1, (1 << 22) // size)
    for a in range(0, len(whole) if ok else 0, k):
        w, inner = whole[a : a + k], np.arange(size)
        if not np.array_equal(data[at[w][:, None] + inner], data[at[same[w]][:, None] + inner]):
            ok = False
            break
    if ok:
        return which
    numbers: dict[tuple[int, bytes], int] = {}
    text = data.tobytes()
    return np.array([numbers.setdefault((int(names[w]), text[x : x + size]), len(numbers)) for w, x in zip(which.tolist(), at.tolist(), strict=True)])


def _compare(kind: Kind) -> Callable:
    """Contexts sorted by lead: the runs of windows (doc, rk, lo, hi) that are repeated within their lead's group."""

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        lead1, lead2, doc, rk, lo, hi, weight = (batch.column(i).to_numpy() for i in range(7))
        data, offsets = _binary(batch.column(7))
        key, of, place = _windows(kind, [lead1, lead2, lo, hi], data, offsets)
        names, first, which = np.unique(key, return_index=True, return_inverse=True)
        which = by_content(names, first, which, data, *kind.contents(offsets, hi.astype(np.int64) - lo + 1))
        if kind.by_order:
            least = np.full(len(which), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc[of])
            hit = doc[of] > least[which]
        else:
            hit = np.bincount(which, weight[of])[which] >= 2 if len(which) else np.zeros(0, bool)
        begin = hit.copy()
        begin[1:] &= ~(hit[:-1] & (of[1:] == of[:-1]))
        end = hit.copy()
        end[:-1] &= ~(hit[1:] & (of[1:] == of[:-1]))
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        return pa.RecordBatch.from_arrays([pa.array(doc[of[s]]), pa.array(rk[of[s]]), pa.array(place[s].astype(np.int32)), pa.array(place[e].astype(np.int32))], names=["doc", "rk", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CONTEXTS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            a, b = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            edge = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            if len(edge):
                yield decide(whole.slice(0, int(edge[-1]) + 1))
                held = [whole.slice(int(edge[-1]) + 1)]
            else:
                held = [whole]
        if held and sum(map(len, held)):
            yield decide(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _window_rows(kind: Kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead1, lead2, doc, rk, lo, hi, weight = (batch.column(i).to_numpy() for i in range(7))
            data, offsets = _binary(batch.column(7))
            one, of, place = _windows(kind, [lead1, lead2, lo, hi], data, offsets)
            two = kind.hashes(data, offsets, hi.astype(np.int64) - lo + 1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[of]), pa.array(rk[of]), pa.array(place.astype(np.int32)), pa.array(weight[of])], names=["key1", "key2", "doc", "rk", "lo", "weight"])

    return run


def _salted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with rk and lo) joined with the one row of table for their keys; a key's rows are dealt over SALTS tasks."""
    left = rows.withColumn("_s", F.pmod(F.xxhash64("rk", "lo"), F.lit(SALTS)).cast("int"))
    right = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_s"]).drop("_s")


def repeated_windows(rows: DataFrame, kind: Kind) -> DataFrame:
    """Runs of repeated windows (doc, rk, lo, hi: first and last start) in rows (doc long, rk long, text); doc and rk are equal for rows
    of one key and text only. Other columns of rows are kept where texts are shuffled: with_runs on the same rows then reuses that exchange."""
    spark = rows.sparkSession
    whole, rows = rows, rows.select("doc", "rk", "text")
    small_batches(spark)
    parts = shuffle_partitions(spark)
    fractions = F.array(*(F.lit((i + 1) / parts) for i in range(parts - 1))) if parts > 1 else F.array(F.lit(0.5))
    found = _records(rows.sample(SPLIT_SAMPLE, seed=7), kind, None).agg(F.percentile_approx("lead1", fractions, max(10_000, SPLIT_ACCURACY * parts))).first()[0]
    splitters = np.array(sorted(found or []), np.int64)
    hot = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])
    dealt = _records(rows, kind, splitters).repartitionById(parts, "bucket")
    table = materialised(map_batches(dealt, _bucket(kind, hot), GROUPED))
    done = table.where("kind = 0").select("doc", "rk", "lo", "hi")
    open_ = table.where("kind = 1").drop("kind")
    if len(hot):
        burning = table.where("kind = 2").drop("kind", "weight")
        one = ["lead1", "lead2", "print1", "print2"]
        size = burning.groupBy(*one).agg(F.count("*").alias("n"), F.min("doc").alias("m"), F.min(F.struct("doc", "rk", "lo")).alias("one"))
        kinds = size.groupBy("lead1", "lead2").agg(F.count("*").alias("k"))
        both = _salted(burning, size.join(kinds, ["lead1", "lead2"]), one)
        if kind.by_order:
            repeated, rest = both.where("doc > m"), both.where("k > 1 and doc = m").withColumn("weight", F.lit(1))
        else:
            repeated = both.where("n > 1")
            rest = both.where("k > 1 and one = struct(doc, rk, lo)").withColumn("weight", F.least("n", F.lit(2)).cast("int")).dropDuplicates(one)
        done = done.union(repeated.select("doc", "rk", "lo", "hi"))
        open_ = open_.unionByName(rest.select(*open_.columns))
    # equal rows have one list, with each record once
    lists = open_.groupBy("doc", "rk").agg(F.collect_set(F.struct("lead1", "lead2", "doc", "rk", "lo", "hi", "weight")).alias("list"))
    texts = whole.join(lists.hint("shuffle_hash"), ["doc", "rk"]).select("text", "list", *(n for n in whole.columns if n not in rows.columns))
    contexts = map_batches(texts, _contexts(kind), CONTEXT)
    if not len(hot):
        return done.union(map_batches(contexts.repartition(parts, "lead1", "lead2").sortWithinPartitions("lead1", "lead2"), _compare(kind), "doc long, rk long, lo int, hi int"))
    contexts = materialised(contexts)
    is_hot = F.shiftright("lead1", SHIFT).isin(hot.tolist())
    cold = map_batches(contexts.where(~is_hot).repartition(parts, "lead1", "lead2").sortWithinPartitions("lead1", "lead2"), _compare(kind), "doc long, rk long, lo int, hi int")
    each = map_batches(contexts.where(is_hot), _window_rows(kind), "key1 long, key2 long, doc long, rk long, lo int, weight int")
    key = ["key1", "key2"]
    if kind.by_order:
        warm = _salted(each, each.groupBy(*key).agg(F.min("doc").alias("m"), F.max("doc").alias("x")).where("x > m"), key).where("doc > m")
    else:
        warm = _salted(each, each.groupBy(*key).agg(F.sum("weight").alias("n")).where("n > 1"), key)
    return done.union(cold).union(warm.select("doc", "rk", "lo", F.col("lo").alias("hi")))


def with_runs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc, rk, ...) with a column runs: list of its repeated windows' (lo, hi), or null."""
    lists = found.groupBy("doc", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    return rows.join(lists.hint("shuffle_hash"), ["doc", "rk"], "left")


def coverage(lists: pa.Array, offsets: np.ndarray, window: int) -> np.ndarray:
    """For units (rows delimited by offsets): whether one of the row's windows covers it."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.zeros(len(lists), np.int64)
    counts = lists.value_lengths().fill_null(0).to_numpy()
    size[:] = counts
    flat = lists.flatten().flatten()
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    if len(flat) and size.sum():
        base = np.repeat(offsets[:-1], size)
        np.add.at(edge, base + flat[0].to_numpy(), 1)
        np.add.at(edge, base + flat[1].to_numpy() + window, -1)
    return np.cumsum(edge[:-1]) > 0
