"""Joins: as-of, band, stab and two-hop joins, suffix-prefix overlap, k-mers; the similarity join of sequences is in similarity.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.sequence import twin
from ..schemas import OVERLAP_CLIP, OVERLAP_END
from .similarity import align  # noqa: F401

c = F.col


def with_lengths(aln: DataFrame, lengths: DataFrame) -> DataFrame:
    """Alignments with lr and lq, the lengths (name, len) of ref and qry. Small tables are broadcast by their size."""
    r, q = lengths.select(c("name").alias("ref"), c("len").alias("lr")), lengths.select(c("name").alias("qry"), c("len").alias("lq"))
    return aln.join(r, "ref").join(q, "qry")


def dealt_pairs(left: DataFrame, right: DataFrame, group: str, name: str, blocks: int | None = None) -> DataFrame:
    """Equal join on group where groups are few and pairs many: left is dealt by its name into blocks of every group (as many as shuffle partitions at least), the smaller right side is
    there once per block. However few files or groups there are, pairs are made by all tasks; they are streamed, so a task holds a block's rows of right alone."""
    spark = left.sparkSession
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    a = left.withColumn("_b", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")).repartition(blocks * 4, group, "_b")
    b = right.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks * 4, group, "_b")
    return a.join(b.hint("shuffle_hash"), [group, "_b"]).drop("_b")


#: Rows of the left and of the right side that meet in one call.
CELL = 4096, 1024
#: Tasks at most, and rows of the left and of the right side whose pairs are one row of Arrow.
TASKS, TILE = 4096, (16, 8)


def pair_distances(left: DataFrame, right: DataFrame, group: str, distances: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """(left's key, right's key, d) for all pairs of a group, of left (group, key, string) and right (group, key, string); d is null where a string is. Both sides of a group are dealt
    into blocks of CELL rows, each pair of blocks is one call of distances, and its rows are unpacked by Spark, so neither a task's memory nor what it makes grows with a group."""
    a, x = (k for k in left.columns if k != group)
    b, y = (k for k in right.columns if k != group)
    blocks = lambda df, size, name: df.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = blocks(left, CELL[0], "_m").join(blocks(right, CELL[1], "_n"), group)
    tasks = max(1, min(TASKS, 4 * (grid.agg(F.sum(c("_m").cast("long") * c("_n"))).first()[0] or 0)))
    dealt = lambda df, own, k, s: df.join(grid, group).withColumn(f"_{own}", F.pmod(F.xxhash64(k, s), f"_{own}").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    cell = [group, "_m", "_n"]
    lefts = dealt(left, "m", a, x).withColumn("_n", every("_n")).repartition(tasks, *cell)
    rights = dealt(right, "n", b, y).withColumn("_m", every("_m")).select(group, b, y, "_m", "_n").repartition(tasks, *cell)
    keys = left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()
    tiles = lefts.groupBy(*cell).cogroup(rights.groupBy(*cell)).applyInArrow(_tiles((a, x, b, y), distances), f"a array<{keys[0]}>, b array<{keys[1]}>, d array<int>")
    return tiles.select("a", "b", F.posexplode("d").alias("_k", "d")).select(F.expr("a[_k div size(b)]").alias(a), F.expr("b[_k % size(b)]").alias(b), "d")


def _tiles(names: tuple[str, str, str, str], distances: Callable) -> Callable:
    """Of the rows of a cell: for up to TILE rows of each side (a, b, d: all pairs, those of a row of left together)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, (b, y) = left.column(names[0]).combine_chunks(), (right.column(k).combine_chunks() for k in names[2:])
        x = left.column(names[1]).combine_chunks()
        schema = pa.schema([("a", pa.list_(keys.type)), ("b", pa.list_(b.type)), ("d", pa.list_(pa.int32()))])
        if not len(x) or not len(y):
            return schema.empty_table()
        d = distances(x.fill_null("").to_pylist(), y.fill_null("").to_pylist())
        no_x, no_y = (k.is_null().to_numpy(zero_copy_only=False) for k in (x, y))
        size = np.diff(np.arange(0, len(x), TILE[0]), append=len(x))
        whole = len(y) - len(y) % TILE[1]
        step = TILE[1] * max(1, (1 << 18) // (len(x) * TILE[1]))
        out = []
        for i, j in [*((i, min(whole, i + step)) for i in range(0, whole, step)), *([(whole, len(y))] if whole < len(y) else [])]:
            wide = min(TILE[1], j - i)
            bands = (j - i) // wide
            turned = lambda v, n=bands, w=wide: np.ascontiguousarray(v.reshape(n, w, len(x)).transpose(0, 2, 1)).ravel()
            missing = turned(no_y[i:j, None] | no_x) if no_x.any() or no_y.any() else None
            ends = np.concatenate([[0], np.cumsum(np.tile(size, bands))]).astype(np.int32)
            of_b = np.repeat(np.arange(i, j).reshape(bands, wide), len(size), axis=0).ravel()
            lists = [(ends, keys.take(pa.array(np.tile(np.arange(len(x)), bands)))), (np.arange(len(ends), dtype=np.int32) * wide, b.take(pa.array(of_b))), (ends * wide, pa.array(turned(d[i:j]), mask=missing))]
            out.append(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(*v) for v in lists], schema=schema))
        return pa.Table.from_batches(out)

    return run


def partner(points: DataFrame, group: str, at: str, kind: str, gap) -> DataFrame:
    """For L points the next R point, for R points the last L point of the group within gap, else null: one window, no join."""
    nxt = F.min(F.when(c(kind) == "R", c(at))).over(Window.partitionBy(group).orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    last = F.max(F.when(c(kind) == "L", c(at))).over(Window.partitionBy(group).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.when(c(kind) == "L", nxt).otherwise(last)
    return points.withColumn("partner", F.when(F.abs(near - c(at)) <= gap, near))


def band_semi(left: DataFrame, right: DataFrame, at: str, apart: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left with a row of right whose `at` differs by less than apart: equal join on bins, right put in three of them."""
    r = right.select(*(c(k).alias(f"_{k}") for k in keys), c(at).alias("_r"), F.explode(F.array(*(F.floor(c(at) / apart) + k for k in (-1, 0, 1)))).alias("_c")).distinct()
    on = (F.floor(c(at) / apart) == c("_c")) & (F.abs(c(at) - c("_r")) < apart)
    for k in keys:
        on = on & (c(k) == c(f"_{k}"))
    return left.join(r, on, "left_semi")


def stab(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """(group, at, start, end) of points in ranges, by bins of about a range's width."""
    bins = ranges.select(c(group).alias("_g"), c(start), c(end), F.explode(F.sequence(F.floor(c(start) / width), F.floor(c(end) / width))).alias("_c"))
    p = points.withColumn("_b", F.floor(c(at) / width))
    return p.join(bins, (c(group) == c("_g")) & (c("_b") == c("_c")) & (c(at) >= c(start)) & (c(at) <= c(end))).drop("_g", "_b", "_c")


def first_stab(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Each range with its first point, points in ranges only once (their first range)."""
    hits = stab(points, ranges, group, at, start, end, width)
    per_range = hits.withColumn("_n", F.row_number().over(Window.partitionBy(group, start, end).orderBy(at))).where("_n = 1")
    return per_range.withColumn("_n", F.row_number().over(Window.partitionBy(group, at).orderBy(start, end))).where("_n = 1").drop("_n")


def read_bridges(attached: DataFrame, least: int = 0) -> DataFrame:
    """Contig pairs that a read links: attached (read, node, side, len) with side L or R; different contigs only, shorter attachment counts."""
    left = attached.where("side = 'L'").select("read", c("node").alias("l"), c("len").alias("ll"))
    right = attached.where("side = 'R'").select("read", c("node").alias("r"), c("len").alias("rl"))
    out = left.join(right, "read").where(F.floor(c("l") / 2) != F.floor(c("r") / 2))
    return out.select("read", "l", "r", F.least("ll", "rl").alias("len")).where(c("len") >= least)


def supported(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """Edges (src, dst, wt) that a row of extra (src, dst, l1, l2) supports with a shorter length of wt or more."""
    best = extra.groupBy("src", "dst").agg(F.max(F.least("l1", "l2")).alias("m"))
    return edges.join(best, ["src", "dst"]).where("m >= wt").select(*edges.columns)


def two_hop(ends: DataFrame, best_only: bool = True) -> DataFrame:
    """Contigs that share reads: ends (contig, read) gives (a, b, n reads); best_only: b with most reads, ties to the larger name."""
    a, b = ends.select(c("contig").alias("a"), "read").distinct(), ends.select(c("contig").alias("b"), "read").distinct()
    out = a.join(b, "read").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    if not best_only:
        return out
    return out.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b", "m.n")


def embedded_edges(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """Contigs inside a read inherit its edges: inside (node, read_node)."""
    out = inside.join(edges, c("read_node") == c("src")).select(c("node").alias("src"), "dst", "wt")
    into = inside.join(edges, c("read_node") == c("dst")).select("src", c("node").alias("dst"), "wt")
    return out.union(into).where("src <> dst").distinct()


def attachments(aln: DataFrame, near: int) -> DataFrame:
    """Reads attached to contig ends: one row per end of ref that the match touches, or two."""
    sides = F.array_compact(F.array(F.when(c("s1") <= near, F.lit("L")), F.when(c("e1") >= c("lr") - near, F.lit("R"))))
    return aln.select(c("qry").alias("read"), c("ref").alias("contig"), F.explode(sides).alias("side"), c("len1").alias("len"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Pairs (src, dst) and their twins on the other strand."""
    return pairs.union(pairs.select(twin("dst"), twin("src"))).distinct()


def without(all_rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return all_rows.join(gone.select(key).distinct(), key, "left_anti")


def overlap_length(left: str, right: str, seed: int = 12, end: int = OVERLAP_END, clip: int = OVERLAP_CLIP) -> tuple[int, int]:
    """Lengths on left and right of the longest suffix-prefix overlap: exact seeds on one diagonal, from within `end` of right's start
    to within `end` of left's end. (0, 0) without one."""
    a, b = left[-clip:], right[:clip]
    if not a or not b:
        return 0, 0
    k = min(seed + 1, len(a), len(b))
    at = a.find(b[:k], max(0, len(a) - len(b)))
    while at >= 0:  # exact overlap
        if a[at:] == b[: len(a) - at]:
            return len(a) - at, len(a) - at
        at = a.find(b[:k], at + 1)
    best = (0, 0)
    for off in range(min(end, max(0, len(b) - seed)) + 1):
        probe = b[off : off + seed]
        at = a.find(probe)
        while at >= 0:
            n, m = len(a) - at, 0
            stop = min(len(a) - at, len(b) - off)
            while m < stop and a[at + m] == b[off + m]:
                m += 1
            if at + m >= len(a) - end and n + off > best[0]:
                best = (n, off + m)
            at = a.find(probe, at + 1)
    return best


@F.pandas_udf(StructType([StructField("left", IntegerType()), StructField("right", IntegerType())]))
def overlaps(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([overlap_length(a or "", b or "") for a, b in zip(left, right, strict=True)], columns=["left", "right"], dtype="int32")


def exact_overlap(a: Column, b: Column, most: int) -> Column:
    """Longest exact suffix of a that is a prefix of b, up to `most` letters, as an expression."""
    sizes = F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b), F.lit(most))), lambda n: F.right(a, n) == F.left(b, n))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.coalesce(F.array_max(sizes), F.lit(0))).otherwise(0)


# k-mers


def _kmers(k: int, step: int) -> Callable:
    """(name, seq) to k-mers by a rolling hash; every step-th place only."""
    code = np.full(256, 4, np.uint64)
    for i, letter in enumerate(b"ACGT"):
        code[letter] = i

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, seq in zip(pdf["name"], pdf["seq"], strict=True):
                x = code[np.frombuffer((seq or "").encode(), np.uint8)]
                n = len(x) - k + 1
                if n <= 0:
                    continue
                h = np.zeros(n, np.uint64)
                bad = np.zeros(n, bool)
                for i in range(k):  # 2 bits a letter: exact up to 32 letters
                    h = h << np.uint64(2) | (x[i : i + n] & np.uint64(3))
                    bad |= x[i : i + n] == 4
                at = np.flatnonzero(~bad)
                at = at[at % step == 0]
                yield pd.DataFrame({"name": name, "pos": at.astype(np.int32), "kmer": h[at].view(np.int64)})

    return run


def seeds(seqs: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(name, pos, kmer): exact k-mers, 2 bits a letter, so k is at most 31. Places with other letters have none."""
    if k > 31:
        raise ValueError("k is at most 31")
    return seqs.select("name", "seq").mapInPandas(_kmers(k, step), "name string, pos int, kmer long")
