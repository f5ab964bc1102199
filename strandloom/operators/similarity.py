"""The similarity join of sequences: minimizers as seeds, maximal exact matches, collinear chains.

Seeds are minimizers: of each `w` consecutive s-mers the one with the least hash, so any exact match of k = s + w - 1 letters holds a whole window and both sides choose the same
seed in it. A seed carries the w letters before and behind it, 2 bits each: its match reaches no farther than that without holding the next seed, so a match is the union of its seeds'
stretches on one diagonal and no sequence is read again. All maximal exact matches of k letters or more come out, and no others.

A seed that refs have more than OFTEN times isn't joined on its s letters but on each whole window of k letters that chose it, so every pair that is made
belongs to a match in the result, and other seeds make OFTEN pairs for each of the queries' at most; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialised

c = F.col
#: Letters that are turned into seeds at once, and places of a seed in refs above which whole windows are joined.
PIECE, OFTEN = 1 << 20, 64
#: Different seeds of refs up to which tasks of the queries know them all (8 bytes each) and give no others; beyond, the join alone selects.
KNOWN = 1 << 20
CODE = np.full(256, 4, np.uint8)
CODE[list(b"ACGT")] = range(4)


def seed_size(k: int) -> tuple[int, int]:
    """Letters of a seed and seeds of a window, for matches of k letters."""
    if not 8 <= k <= 45:
        raise ValueError("k is from 8 to 45")
    s = max(min(k, 11), 2 * k // 3 + 1)
    return s, k - s + 1


def _order(x: np.ndarray) -> np.ndarray:
    """A bijective hash, by which minimizers are chosen."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(f: Callable, x: np.ndarray, w: int) -> np.ndarray:
    """f (minimum or maximum) over each w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = f(x[:-span], x[span:])
        span *= 2
    return x if span == w else f(x[: len(x) - (w - span)], x[w - span :])


def _mers(two: np.ndarray, s: int) -> np.ndarray:
    """s consecutive letters as one number, by doubling."""
    out, size = np.zeros(len(two) + 1, np.uint64), 0
    part, span = two, 1
    while s:
        if s & 1:
            n = len(two) - size - span + 1
            out, size = out[:n] << np.uint64(2 * span) | part[size : size + n], size + span
        s >>= 1
        if s:
            part = part[:-span] << np.uint64(2 * span) | part[span:]
            span *= 2
    return out


def minimizers(x: np.ndarray, s: int, w: int, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Place, s-mer, letters before and behind (w of each, the nearest in the highest bits) and how many of these are there, for each minimizer of codes x (4: no letter).
    Of equal s-mers in a window all are taken. known: only these s-mers (in order) are given."""
    n = len(x) - s - w + 2
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    bad = np.concatenate([[0], np.cumsum(x == 4, dtype=np.int64)])
    two = (x & 3).astype(np.uint64)
    mers = _mers(two, s)
    rank = _order(mers) | np.uint64(1)
    # of each window its least rank, none if it holds a place without a letter; a seed is chosen if the largest of its windows' is its own
    least = np.where(bad[s + w - 1 :][:n] == bad[:n], _sliding(np.minimum, rank, w), np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), w) == rank)
    if known is not None:
        own = mers[chosen]
        chosen = chosen[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own] if len(known) else chosen[:0]
    last = np.maximum.accumulate(np.where(x == 4, np.arange(len(x)), -1))
    following = np.minimum.accumulate(np.where(x == 4, np.arange(len(x)), len(x))[::-1])[::-1]
    padded = np.concatenate([np.zeros(w, np.uint64), two, np.zeros(w, np.uint64)])
    left, right = np.zeros(len(chosen), np.uint64), np.zeros(len(chosen), np.uint64)
    for i in range(w):
        left = left << np.uint64(2) | padded[chosen + w - 1 - i]
        right = right << np.uint64(2) | padded[chosen + w + s + i]
    n_left = np.minimum(w, chosen - 1 - np.where(chosen > 0, last[np.maximum(chosen - 1, 0)], -1))
    n_right = np.minimum(w, np.where(chosen + s < len(x), following[np.minimum(chosen + s, len(x) - 1)], len(x)) - chosen - s)
    return chosen, mers[chosen], left, right, n_left, n_right


def _seeds(s: int, w: int, strands: str, known: np.ndarray | None) -> Callable:
    """(name, seq) to seeds of the strands, a bounded piece of all letters of a batch at a time."""
    margin = s + 2 * w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0)
            texts = [(t or "").encode("ascii", "replace") for t in batch.column(1).to_pylist()]
            size = np.array([len(t) + 1 for t in texts], np.int64)
            begin = np.cumsum(size) - size
            # a place without a letter behind each sequence: no seed spans two
            forward = CODE[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
            for strand in strands:
                # the complement read backwards: sequences come in reversed order, each behind its place without a letter
                x = forward if strand == "p" else np.where(forward == 4, 4, 3 - forward)[::-1]
                for a in range(0, len(x), PIECE):
                    low = max(0, a - margin)
                    at, *rest = minimizers(x[low : a + PIECE + margin], s, w, known)
                    keep = (at + low >= a) & (at + low < a + PIECE)
                    at, (mer, left, right, n_left, n_right) = at[keep] + low, (v[keep] for v in rest)
                    if not len(at):
                        continue
                    row = np.searchsorted(begin, at if strand == "p" else len(x) - 1 - at, "right") - 1
                    pos = at - begin[row] if strand == "p" else at - (len(x) - begin[row] - size[row]) - 1
                    yield pa.RecordBatch.from_arrays([
                        name.take(pa.array(row)), pa.array([strand] * len(row)), pa.array(pos.astype(np.int32)),
                        *(pa.array(v.view(np.int64)) for v in (mer, left, right)), *(pa.array(v.astype(np.int32)) for v in (n_left, n_right, size[row] - 1)),
                    ], names=["name", "strand", "pos", "mer", "left", "right", "n_left", "n_right", "len"])

    return run


def sketch(seqs: DataFrame, k: int, strands: str = "p", known: np.ndarray | None = None) -> DataFrame:
    """(name, strand, pos, mer, left, right, n_left, n_right, len): minimizers of sequences (name, seq) of len letters for matches of k letters; strand d: of the reversed
    complement."""
    kind = seqs.schema["name"].dataType.simpleString()
    return seqs.select("name", "seq").mapInArrow(_seeds(*seed_size(k), strands, known), f"name {kind}, strand string, pos int, mer long, left long, right long, n_left int, n_right int, len int")


def _equal(a: str, b: str, na: str, nb: str, w: int) -> Column:
    """How many of the nearest letters agree."""
    x = c(a).bitwiseXOR(c(b))
    same = F.when(x == 0, w).otherwise(w - F.ceil(F.length(F.bin(x)) / 2))
    return F.least(same, c(na), c(nb)).cast("int")


def _windows(seeds: DataFrame, s: int, w: int, n_left: str, n_right: str, left: str, right: str) -> DataFrame:
    """Each seed once for each window of k letters around it: (.., before, wl, wr), the letters of the window on either side."""
    rows = seeds.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(w - 1)))).where((c(n_left) >= c("before")) & (c(n_right) >= w - 1 - c("before")))
    return rows.withColumn("wl", F.expr(f"shiftright({left}, 2 * ({w} - before))")).withColumn("wr", F.expr(f"shiftright({right}, 2 * (1 + before))"))


def sized_matches(refs: DataFrame, queries: DataFrame, k: int, unique: bool, strands: str) -> DataFrame:
    """The maximal matches with lq, the letters of the query."""
    s, w = seed_size(k)
    r = materialised(sketch(refs, k).select(c("name").alias("ref"), c("pos").alias("p1"), "mer", c("left").alias("l1"), c("right").alias("r1"), c("n_left").alias("nl1"), c("n_right").alias("nr1")))
    different = r.select("mer").distinct()
    if unique:
        different = r.groupBy("mer").agg(F.count("*").alias("n")).where("n = 1").select("mer")
    few = different.limit(KNOWN + 1).toPandas()["mer"].to_numpy(np.int64).view(np.uint64)
    q = sketch(queries, k, strands, np.sort(few) if len(few) <= KNOWN else None).select(c("name").alias("qry"), "strand", c("pos").alias("p2"), "mer", c("left").alias("l2"), c("right").alias("r2"), c("n_left").alias("nl2"), c("n_right").alias("nr2"), c("len").alias("lq"))
    often = materialised(r.groupBy("mer").agg(F.count("*").alias("n")).where(c("n") > (1 if unique else OFTEN)).select("mer"))
    if not often.limit(1).count():
        hits = r.join(q, "mer")
    elif unique:
        hits = r.join(often, "mer", "left_anti").join(q, "mer")
    else:
        q = materialised(q)
        hits = r.join(often, "mer", "left_anti").join(q, "mer")
        wr = _windows(r.join(often, "mer", "left_semi"), s, w, "nl1", "nr1", "l1", "r1")
        wq = _windows(q.join(often, "mer", "left_semi"), s, w, "nl2", "nr2", "l2", "r2")
        hits = hits.unionByName(wr.join(wq, ["mer", "before", "wl", "wr"]).drop("before", "wl", "wr"))
    hits = hits.withColumn("x", _equal("l1", "l2", "nl1", "nl2", w)).withColumn("y", _equal("r1", "r2", "nr1", "nr2", w)).where(c("x") + c("y") + s >= k)
    hits = hits.select("ref", "qry", "strand", "lq", (c("p1") - c("p2")).alias("diag"), (c("p1") - c("x")).alias("a"), (c("p1") + s + c("y")).alias("b"))
    d = Window.partitionBy("ref", "qry", "strand", "diag").orderBy("a")
    reach = F.max("b").over(d.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("run", F.coalesce(c("a") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("run").over(d.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("ref", "qry", "strand", "diag", "run").agg(F.min("a").alias("a1"), F.max("b").alias("b1"), F.min("lq").alias("lq"))
    return out.select("ref", "qry", "strand", "a1", "b1", (c("a1") - c("diag")).alias("a2"), (c("b1") - c("diag")).alias("b2"), "lq")


def maximal_matches(refs: DataFrame, queries: DataFrame, k: int = 20, unique: bool = False, strands: str = "pd") -> DataFrame:
    """(ref, qry, strand, a1, b1, a2, b2): all maximal exact matches of k letters or more between refs and queries (name, seq), as half-open places. Strand d: of the
    reversed complement of the query, whose places a2 and b2 are. unique: only matches that hold a seed which all refs together have once."""
    return sized_matches(refs, queries, k, unique, strands).drop("lq")


def collinear(a1: list[int], a2: list[int], size: list[int]) -> list[int]:
    """A chain for each match (numbers from 0): matches of a chain begin later and later on both sides. A match follows the chain of most letters that it can (a Fenwick array of
    maxima over places on the second side); chains are taken from the heaviest end on, and end where they meet a heavier one."""
    n = len(a1)
    order = sorted(range(n), key=lambda i: (a1[i], a2[i], i))
    places = {v: r + 1 for r, v in enumerate(sorted(set(a2)))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(places) + 1)
    total, before = [0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and a1[order[j]] == a1[order[i]]:
            m = order[j]
            at, best = places[a2[m]] - 1, (0, -1)
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            total[m], before[m] = best[0] + size[m], best[1]
            j += 1
        for m in order[i:j]:
            at = places[a2[m]]
            while at < len(tree):
                tree[at] = max(tree[at], (total[m], m))
                at += at & -at
        i = j
    label, chain = [-1] * n, 0
    for m in sorted(range(n), key=lambda i: (-total[i], a1[i], a2[i])):
        if label[m] >= 0:
            continue
        while m >= 0 and label[m] < 0:
            label[m] = chain
            m = before[m]
        chain += 1
    return label


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (g, .., a1, b1, a2, b2) sorted by cluster g, with the number of their chain in it."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, a1, b1, a2 = (table.column(x).to_numpy() for x in ("g", "a1", "b1", "a2"))
        edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        out = np.zeros(len(g), np.int32)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                out[a:b] = collinear(a1[a:b].tolist(), a2[a:b].tolist(), (b1[a:b] - a1[a:b]).tolist())
        yield from table.append_column("link", pa.array(out)).combine_chunks().to_batches()

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        g = table.column("g").to_numpy()
        whole = int(np.searchsorted(g, g[-1]))
        if whole and len(g) > 4096:
            yield from done(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield from done(pa.Table.from_batches(held))


def clusters(matches: DataFrame, gap: int, drift: int) -> DataFrame:
    """Matches with band and chain: diagonals of neighbours differ by drift at most, and places by gap. One window per side, no join."""
    band = Window.partitionBy("ref", "qry", "strand").orderBy("diag")
    rows = matches.withColumn("diag", c("a1") - c("a2"))
    rows = rows.withColumn("shift", (F.coalesce(c("diag") - F.lag("diag").over(band), F.lit(0)) > drift).cast("int"))
    rows = rows.withColumn("band", F.sum("shift").over(band.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("ref", "qry", "strand", "band").orderBy("a1", "b1")
    reach = F.max("b1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(c("a1") > reach + gap, F.lit(True)).cast("int")).withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("diag", "shift", "new")


def chained(matches: DataFrame, gap: int = 100, drift: int = 30) -> DataFrame:
    """(ref, qry, strand, lq, a1, b1, a2, b2, cover) of chains of matches (with lq): clusters of near matches, each split into collinear chains. cover: letters of the ref's stretch
    that matches hold. Clusters of one match never leave the JVM."""
    key = ["ref", "qry", "strand", "lq", "band", "chain"]
    rows = clusters(matches, gap, drift).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    several = rows.where("n > 1").withColumn("g", F.xxhash64(*key)).repartition("g").sortWithinPartitions("g", "a1", "a2", "b1")
    linked = several.mapInArrow(_chained, several.select("*", F.lit(0).alias("link")).schema)
    w = Window.partitionBy(*key, "link").orderBy("a1", "b1").rowsBetween(Window.unboundedPreceding, -1)
    own = c("b1") - F.greatest(c("a1"), F.coalesce(F.max("b1").over(w), c("a1")))
    linked = linked.withColumn("cover", F.greatest(F.lit(0), own))
    joined = linked.groupBy(*key, "link").agg(F.min("a1").alias("a1"), F.max("b1").alias("b1"), F.min("a2").alias("a2"), F.max("b2").alias("b2"), F.sum("cover").alias("cover"))
    alone = rows.where("n = 1").select("ref", "qry", "strand", "lq", "a1", "b1", "a2", "b2", (c("b1") - c("a1")).cast("long").alias("cover"))
    return alone.union(joined.select(*alone.columns))


def align(refs: DataFrame, queries: DataFrame, k: int = 20, gap: int = 100, least: int = 40, drift: int = 30, unique: bool = False) -> DataFrame:
    """Alignment rows of queries on refs, both strands: maximal exact matches of k letters or more, in collinear chains. Each chain of `least` letters or more is
    one row: its extent, and as identity the share of it that matches cover. unique: matches hold a seed that refs have once."""
    rows = chained(sized_matches(refs, queries, k, unique, "pd"), gap, drift).where(c("b1") - c("a1") >= least)
    p = c("strand") == "p"
    idy = F.round(F.least(F.lit(100.0), c("cover") * 100.0 / (c("b1") - c("a1"))), 2)
    return rows.select(
        (c("a1") + 1).cast("int").alias("s1"), c("b1").cast("int").alias("e1"),
        F.when(p, c("a2") + 1).otherwise(c("lq") - c("a2")).cast("int").alias("s2"), F.when(p, c("b2")).otherwise(c("lq") - c("b2") + 1).cast("int").alias("e2"),
        (c("b1") - c("a1")).cast("int").alias("len1"), (c("b2") - c("a2")).cast("int").alias("len2"), idy.alias("idy"), "ref", "qry",
    )
