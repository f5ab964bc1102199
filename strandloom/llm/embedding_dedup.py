"""Near-duplicate embeddings: a robust-pruned flat graph over overlapping cluster shards, searched by range.

1. Equal vectors are one class; classes carry how many rows they stand for.
2. Shards are made top down: a shard of more than SPLIT classes is split by centroids fitted on a bounded sample of its own (SAMPLE, by
   hash), FAN at most, and its classes are dealt in groups of ROUTED to be routed, so a shard may have any size and there may be any number of shards.
   Every class goes to the shards of its nearest centroids: OVERLAP of them, or as many more as it takes for a share of MEET of planted
   pairs to meet in one. A class that comes from several shards keeps as many of all its new ones, the nearest, so copies don't multiply from level to level. Planted pairs are sampled vectors that no centroid was fitted on, each with a partner at a cosine of
   exactly the threshold. A shard of more than LIMIT classes is dealt into blocks,
   and each pair of blocks is a cell of its own, so that no task holds an unbounded shard; shards that centroids can't split end so as well.
3. In each cell every class gets the neighbours that robust pruning leaves of its nearest ones (found by a matrix product, which for so few
   vectors costs less than any search), and the reverse edges. The adjacency lists of a class from all its cells are united.
4. In each cell all its classes search from the cell's medoids (the vector next to the mean, and ENTRIES - 1 that are far from each other): a greedy
   search with a beam, then expansion along edges
   from vectors in range for as long as new ones are in range. Every hit is verified in double precision. Rows within half the angle of the threshold of the medoid are all linked with one another,
   so a cell of near copies counts them as a ball, without their pairs. A pair counts in one cell
   only, the first that both are in; counts and spanning links leave a task, never pairs.
5. Recall is audited: classes by hash are compared with all others by brute force, AUDIT at first and then in growing blocks, until
   LINKED of them have links or AUDIT_MOST or a fiftieth of all classes (whichever is more) are done. Recall is the mean over audited classes
   with links of the share found of each one's links; it is a column of the result (null if no audited class has a link). Below LEAST_RECALL the search is done again with twice the overlap, AGAIN times at most, and then all classes are compared with all others, block
   against block; so they are at once if no audited class has a link, unless all classes were audited. That is exact, and its recall is 1.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of different
lengths. Rows with a null id take part but never name a component; rows that share an id are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, map_batches, materialised, shuffle_partitions, small_batches
from .minhash_dedup import bounds, forest, groups

SAMPLE, SHARD, FAN, OVERLAP = 20_000, 600, 1024, 2
LIMIT, SPLIT, ROUTED = 2048, 8192, 20_000
#: A split is given up if a child has more than this share of its parent; overlap stops at this share of the children.
SHRINK, WIDEST = 0.7, 0.25
#: Times that overlap is doubled, at most.
AGAIN = 3
ENTRIES = 8
NEAREST, DEGREE, ALPHA, BEAM, STEPS = 64, 24, 1.2, 24, 48
AUDIT, LINKED, AUDIT_MOST, AUDIT_BLOCK, LEAST_RECALL = 256, 200, 4096, 4096, 0.9
PLANTED, MEET = 2000, 0.95
#: Rows of a cell from which those around its medoid are linked as a ball.
BALL = 64


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) as id, node (hash of the vector) and unit vector in doubles, or nulls."""
    for batch in batches:
        names, vectors = [], []
        for v in batch.column(1):
            x = None if not v.is_valid else v.values.cast(pa.float64())
            x = None if x is None or not len(x) or x.null_count else x.to_numpy()
            norm = 0.0
            if x is not None and np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                norm = float(np.sqrt((x * x).sum()))
            if norm > 0:
                data = (x / norm + 0.0).tobytes()
                vectors.append(data)
                names.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
            else:
                vectors.append(None)
                names.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "node", "vec"])


def matrix(column: pa.Array) -> np.ndarray:
    x = b"".join(column.to_pylist())
    return np.frombuffer(x, np.float64).reshape(len(column), -1)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, a few rounds from a fixed choice of rows."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def planted_overlap(x: np.ndarray, c: np.ndarray, least: float) -> int:
    """The overlap at which a share of MEET of the pairs (row of x, random partner at a cosine of least) have one of their nearest centroids in common."""
    if len(c) < 2 or x.shape[1] < 2 or not len(x):
        return 1
    u = np.random.default_rng(13).normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * u / np.linalg.norm(u, axis=1)[:, None]
    rank = lambda z: np.argsort(np.argsort(-(z @ c.T), 1, kind="stable"), 1, kind="stable")
    need = np.maximum(rank(x), rank(y)).min(1) + 1
    return int(np.quantile(need, MEET, method="higher"))


def _fit(least: float, wanted: int) -> Callable:
    """Of one shard (shard, size, vec; a sample): its children (shard, child, children, overlap, centre)."""

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec").combine_chunks())
        k = min(FAN, -(-table.column("size")[0].as_py() // SHARD), len(x))
        aside = min(PLANTED, len(x) // 10)
        c = centroids(x[: len(x) - aside], k)
        most = max(1, int(len(c) * WIDEST))
        overlap = max(1, min(most, max(wanted, planted_overlap(x[len(x) - aside :], c, least))))
        n = len(c)
        return pa.table({
            "shard": pa.array(np.full(n, table.column("shard")[0].as_py())), "child": pa.array(np.arange(n, dtype=np.int32)),
            "overlap": pa.array(np.full(n, overlap, np.int32)), "centre": pa.array([v.tobytes() for v in c], pa.binary()),
        })

    return run


def _routed(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Rows (shard, part, node, vec) of one part of a shard, once for each of its nearest children, with the cosine of its centre."""
    if not len(rows) or not len(centres):
        return pa.table({"node": pa.array([], pa.int64()), "parent": pa.array([], pa.int64()), "child": pa.array([], pa.int32()), "overlap": pa.array([], pa.int32()), "cosine": pa.array([], pa.float32())})
    centres = centres.sort_by("child")
    c, overlap, parent = matrix(centres.column("centre").combine_chunks()), centres.column("overlap")[0].as_py(), centres.column("shard")[0].as_py()
    x = matrix(rows.column("vec").combine_chunks())
    near = np.concatenate([np.argpartition(-(x[a : a + 2048] @ c.T), overlap - 1, 1)[:, :overlap] for a in range(0, len(x), 2048)]) if overlap < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    n = near.size
    cosine = np.concatenate([np.take_along_axis(x[a : a + 2048] @ c.T, near[a : a + 2048], 1) for a in range(0, len(x), 2048)])
    return pa.table({
        "node": pa.array(np.repeat(rows.column("node").to_numpy(), near.shape[1])), "parent": pa.array(np.full(n, parent)), "child": pa.array(near.ravel().astype(np.int32)),
        "overlap": pa.array(np.full(n, overlap, np.int32)), "cosine": pa.array(cosine.ravel().astype(np.float32)),
    })


def named(parent: str, child: str) -> Column:
    """The name of a shard's child."""
    return F.xxhash64(parent, child)


def shards(classes: DataFrame, least: float, overlap: int) -> DataFrame:
    """(node, shard): the shards of each class (node, vec), several for most. A shard is named by a hash of its parent and its number there, at any depth."""
    first = materialised(classes.select("node", (F.octet_length("vec") / 8).cast("long").alias("shard")))
    now, done = first, None
    given_up = None
    while True:
        size = materialised(now.groupBy("shard").agg(F.count("*").alias("size")))
        large = size.where(F.col("size") > SPLIT)
        if given_up is not None:
            large = large.join(given_up, "shard", "left_anti")
        ready = now.join(large, "shard", "left_anti").select("node", "shard")
        done = ready if done is None else done.union(ready)
        if not large.limit(1).count():
            return done
        rows = materialised(now.join(large, "shard").join(classes.select("node", "vec"), "node"))
        rate = F.pmod(F.xxhash64("node", F.lit(4)), F.lit(1 << 40)) < F.lit(float((1 << 40) * SAMPLE)) / F.col("size")
        centres = materialised(rows.where(rate).select("shard", "size", "vec").groupBy("shard").applyInArrow(_fit(least, overlap), "shard long, child int, overlap int, centre binary"))
        parts = F.ceil(F.col("size") / ROUTED).cast("int")
        dealt = rows.select("shard", F.pmod(F.xxhash64("node", F.lit(6)), parts).cast("int").alias("part"), "node", "vec")
        copies = centres.join(large, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("shard", "part", "child", "overlap", "centre")
        routed = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_routed, "node long, parent long, child int, overlap int, cosine float")
        new = materialised(routed.withColumn("shard", named("parent", "child")))
        # shards of vectors that centroids can't tell apart stay as they are
        child = new.groupBy("parent", "shard").agg(F.count("*").alias("n"))
        stuck = child.groupBy("parent").agg(F.max("n").alias("n")).join(large.withColumnRenamed("shard", "parent"), "parent").where(F.col("n") > F.col("size") * SHRINK).select(F.col("parent").alias("shard"))
        stuck = materialised(stuck)
        given_up = stuck if given_up is None else given_up.union(stuck)
        back = now.join(stuck, "shard").select("node", "shard")
        kept = new.join(stuck.withColumnRenamed("shard", "parent"), "parent", "left_anti")
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("cosine").desc(), "shard"))
        kept = kept.withColumn("place", place).where("place <= overlap").select("node", "shard")
        now = materialised(back.union(kept))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k most similar others of each row, most similar first."""
    out = np.zeros((len(x), k), np.int32)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        part = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(-s, 1)[:, :k]
        out[a : a + 512] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), 1, kind="stable"), 1)
    return out


def robust_prune(x: np.ndarray) -> np.ndarray:
    """Neighbours (-1: none) of each row: the nearest candidate is kept, and candidates that are ALPHA times nearer to it than to the row go."""
    k = min(NEAREST, len(x) - 1)
    near = nearest(x, k)
    out = np.full((len(x), DEGREE), -1, np.int32)
    for a in range(0, len(x), 256):
        c = near[a : a + 256]
        own = 1 - np.einsum("qd,qkd->qk", x[a : a + 256], x[c])
        live = np.ones(c.shape, bool)
        for step in range(DEGREE):
            at = live.argmax(1)
            some = live[np.arange(len(c)), at]
            if not some.any():
                break
            chosen = c[np.arange(len(c)), at]
            out[a : a + 256, step] = np.where(some, chosen, -1)
            live[np.arange(len(c)), at] = False
            between = 1 - np.einsum("qd,qkd->qk", x[chosen], x[c])
            live &= ALPHA**2 * between > own
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (shard, i, j, block, node, vec) sorted: edges (node, to) of robust-pruned graphs, in both directions."""
    for batch in groups(batches, 3, 4096):
        shard, i, j, _, node = (batch.column(k).to_numpy() for k in range(5))
        edge = bounds(shard, i, j)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            near = robust_prune(matrix(batch.column(5).slice(a, b - a)).astype(np.float32))
            u, k = np.nonzero(near >= 0)
            v = near[u, k]
            pairs = np.unique(np.concatenate([u * (b - a) + v, v * (b - a) + u]))
            u, v = pairs // (b - a), pairs % (b - a)
            begin = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node[a:b]), pa.ListArray.from_arrays(pa.array(begin), pa.array(node[a + v]))], names=["node", "near"])


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector next to the mean, and those that are farthest from all before them."""
    out = [int((x @ x.mean(0)).argmax())]
    near = x @ x[out[0]]
    while len(out) < min(ENTRIES, len(x)):
        out.append(int(near.argmin()))
        near = np.maximum(near, x @ x[out[-1]])
    return np.unique(out)


def greedy(x: np.ndarray, table: np.ndarray, start: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Beams (node numbers) after a greedy search from start for x[queries]; table pads neighbours with -1."""
    n = len(queries)
    rows = np.arange(n)
    beam = np.full((n, BEAM), -1, np.int64)
    worth = np.full((n, BEAM), -np.inf, np.float32)
    beam[:, : len(start)], worth[:, : len(start)] = start, x[queries] @ x[start].T
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    done = np.zeros((n, BEAM), bool)
    for _ in range(STEPS):
        best = np.where(done | (beam < 0), -np.inf, worth)
        at = best.argmax(1)
        live = np.isfinite(best[rows, at])
        if not live.any():
            break
        done[rows[live], at[live]] = True
        to = np.where(live[:, None], table[np.maximum(beam[rows, at], 0)], -1)
        fresh = (to >= 0) & ~seen[rows[:, None], to]
        r, k = np.nonzero(fresh)
        seen[r, to[r, k]] = True
        score = np.full(to.shape, -np.inf, np.float32)
        score[r, k] = np.einsum("pd,pd->p", x[queries[r]], x[to[r, k]])
        both, value = np.concatenate([beam, np.where(fresh, to, -1)], 1), np.concatenate([worth, score], 1)
        marks = np.concatenate([done, np.zeros(to.shape, bool)], 1)
        order = np.argpartition(-value, BEAM - 1, axis=1)[:, :BEAM]
        beam, worth, done = (np.take_along_axis(y, order, 1) for y in (both, value, marks))
    return beam


def range_search(x: np.ndarray, table: np.ndarray, least: float, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, hit) with a cosine of least or more for the rows asking, found by expansion from what a greedy search reaches."""
    f = x.astype(np.float32)
    start = medoids(f)
    links = np.zeros((len(x), len(x)), np.float32)
    u, k = np.nonzero(table >= 0)
    links[u, table[u, k]] = 1
    for a in range(0, len(asking), 256):
        queries = asking[a : a + 256]
        beam = greedy(f, table, start, queries)
        seen = np.zeros((len(queries), len(x)), bool)
        hit = np.zeros_like(seen)
        r, c = np.nonzero(beam >= 0)
        new = np.zeros_like(seen)
        new[r, beam[r, c]] = True
        while new.any():
            seen |= new
            r, c = np.nonzero(new)
            near = np.einsum("pd,pd->p", x[queries[r]], x[c]) >= least
            hit[r[near], c[near]] = True
            front = np.zeros(seen.shape, np.float32)
            front[r[near], c[near]] = 1
            new = (front @ links > 0) & ~seen
        r, c = np.nonzero(hit)
        keep = queries[r] != c
        yield queries[r[keep]], c[keep]


def all_pairs(x: np.ndarray, least: float, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(asking), 256):
        u, v = np.nonzero(x[asking[a : a + 256]] @ x.T >= least)
        u = asking[a + u]
        yield u[u != v], v[u != v]


def ball(x: np.ndarray, least: float) -> np.ndarray:
    """Whether a row is within half the angle of the threshold of the vector next to the mean: any two such rows are linked. All false if they are few."""
    near = x @ x[int((x @ x.mean(0)).argmax())] >= np.cos(np.arccos(np.clip(least, -1, 1)) / 2) + 1e-9
    return near if near.sum() >= BALL else np.zeros(len(x), bool)


def first_common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least shard that both of each pair of lists (padded) hold."""
    parts = len(p) // 65536 + 1
    return np.concatenate([np.where((a[:, :, None] == b[:, None, :]).any(2), a, FAR).min(1) for a, b in zip(np.array_split(p, parts), np.array_split(q, parts), strict=True)])


def ball_counts(member: np.ndarray, block: np.ndarray, rows: np.ndarray, shard: int, same_block: bool) -> np.ndarray:
    """Numbers of linked rows among the members of a ball whose pairs count in this cell, by groups that have the same shards and block."""
    kinds, of = np.unique(np.concatenate([member, block[:, None]], 1), axis=0, return_inverse=True)
    of = of.ravel()
    weight = np.bincount(of, rows, len(kinds)).astype(np.int64)
    total, own = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), bool)
    for g in range(len(kinds)):
        ours = first_common(np.repeat(kinds[g : g + 1, :-1], len(kinds), 0), kinds[:, :-1]) == shard
        if not same_block:
            ours &= kinds[:, -1] != kinds[g, -1]
        total[g], own[g] = weight[ours].sum(), ours[g]
    return total[of] - np.where(own[of], rows, 0)


FAR = np.iinfo(np.int64).max


def padded(lists: pa.Array) -> np.ndarray:
    """Lists of shards as a matrix; what is missing is unlike anything else."""
    size = lists.value_lengths().to_numpy()
    out = np.full((len(lists), max(1, int(size.max()))), FAR)
    out[np.repeat(np.arange(len(lists)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _search(least: float, every: bool = False) -> Callable:
    """Cells (shard, i, j, block, node, vec, rows, shards, near) sorted: kind 0 (node, number of linked rows) and kind 1 (links as a forest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 3, 4096):
            shard, i, j, block, node = (batch.column(k).to_numpy() for k in range(5))
            edge = bounds(shard, i, j)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                n = b - a
                if n < 2:
                    continue
                x = matrix(batch.column(5).slice(a, n))
                rows, member = batch.column(6).slice(a, n).to_numpy(), padded(batch.column(7).slice(a, n))
                lists = batch.column(8).slice(a, n)
                order = np.argsort(node[a:b])
                flat = lists.flatten().to_numpy()
                of = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())
                at = np.minimum(np.searchsorted(node[a:b], flat, sorter=order), n - 1)
                here = node[a:b][order[at]] == flat
                of, to = of[here], order[at][here]
                size = np.bincount(of, minlength=n)
                table = np.full((n, max(1, int(size.max()))), -1, np.int64)
                table[of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)] = to
                count = np.zeros(n, np.int64)
                dense = ball(x, least)
                asking = np.flatnonzero(~dense)
                us, vs = [asking[:0]], [asking[:0]]
                for u, v in all_pairs(x, least, asking) if every else range_search(x, table, least, asking):
                    us.append(u), vs.append(v)
                u, v = np.concatenate(us), np.concatenate(vs)
                pair = np.unique(np.minimum(u, v) * n + np.maximum(u, v))
                u, v = pair // n, pair % n
                ours = (first_common(member[u], member[v]) == shard[a]) & ((i[a] == j[a]) | (block[a:b][u] != block[a:b][v]))
                u, v = u[ours], v[ours]
                np.add.at(count, u, rows[v])
                np.add.at(count, v, rows[u])
                held = np.flatnonzero(dense)
                if len(held):
                    count[held] += ball_counts(member[held], block[a:b][held], rows[held], int(shard[a]), bool(i[a] == j[a]))
                    u, v = np.concatenate([u, np.full(len(held) - 1, held[0])]), np.concatenate([v, held[1:]])
                label = forest(n, u, v)
                some, more = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([0, 1], [len(some), len(more)]).astype(np.int32)),
                    pa.array(np.concatenate([node[a:b][some], node[a:b][more]])), pa.array(np.concatenate([count[some], node[a:b][label[more]]])),
                ], names=["kind", "node", "value"])

    return run


def _brute(x: dict[int, np.ndarray], names: dict[int, np.ndarray], least: float) -> Callable:
    """Exact numbers of linked rows of the audited classes, from (node, rows, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pc.binary_length(batch.column(2)).to_numpy() // 8
            for n in np.unique(width):
                if int(n) not in x:
                    continue
                part = batch.take(pa.array(np.flatnonzero(width == n)))
                own, other, rows = names[int(n)], part.column(0).to_numpy(), part.column(1).to_numpy()
                total = np.zeros(len(own), np.int64)
                v = matrix(part.column(2))
                step = max(1, (1 << 21) // len(own))
                for a in range(0, len(v), step):
                    q, k = np.nonzero(x[int(n)] @ v[a : a + step].T >= least)
                    new = own[q] != other[a + k]
                    np.add.at(total, q[new], rows[a + k[new]])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["node", "n"])

    return run


def by_width(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["vec"]) // 8, []).append(r)
    return {n: (np.array([r["node"] for r in v], np.int64), np.stack([np.frombuffer(bytes(r["vec"]), np.float64) for r in v])) for n, v in out.items()}


def audit(classes: DataFrame, total: int, least: float) -> tuple[dict[int, int], bool]:
    """Exact numbers of linked rows of the audited classes that have any, and whether all classes were audited."""
    place = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(max(1, total)))
    most = min(total, max(AUDIT_MOST, total // 50))
    exact: dict[int, int] = {}
    done, size = 0, AUDIT
    while done < most and len(exact) < LINKED:
        upto = min(most, done + size)
        block = by_width(classes.where((place >= done) & (place < upto)).select("node", "vec").collect())
        if block:
            rows = map_batches(classes.select("node", "rows", "vec"), _brute({n: x for n, (_, x) in block.items()}, {n: k for n, (k, _) in block.items()}, least), "node long, n long")
            exact |= {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.sum("n").alias("n")).where("n > 0").collect()}
        done, size = upto, min(AUDIT_BLOCK, 4 * size)
    return exact, done >= total


def mean_recall(exact: dict[int, int], got: dict[int, int]) -> float | None:
    """Mean over classes with links of the share of their links that was found; None without any."""
    return float(np.mean([min(got.get(k, 0), n) / n for k, n in exact.items()])) if exact else None


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding", overlap: int = OVERLAP) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (smallest key reachable) and kept of each row, and the audited recall."""
    spark = vectors.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    unit = materialised(map_batches(vectors.select(vectors[key].cast("long").alias("id"), vectors[column].alias("embedding")), _unit, "id long, node long, vec binary"))
    classes = materialised(unit.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("rows"), F.min("id").alias("first")))
    total = classes.count()
    exact, everything = audit(classes, total, least)
    again, every = 0, False
    cell = ["shard", "i", "j"]
    while True:
        # all classes of one length are one shard if all are compared
        member = materialised(classes.select("node", (F.octet_length("vec") / 8).cast("long").alias("shard")) if every else shards(classes, least, overlap))
        lists = member.groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        member = member.join(lists, "node").join(classes.select("node", "rows", "vec"), "node")
        size = member.groupBy("shard").agg(F.ceil(F.count("*") / LIMIT).cast("int").alias("blocks"))
        member = member.join(size, "shard").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = member.select("shard", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "vec", "rows", "shards")
        if every:
            joined = cells.withColumn("near", F.lit(None).cast("array<long>"))
        else:
            cells = materialised(cells.repartition(parts, *cell))
            built = map_batches(cells.select(*cell, "block", "node", "vec").repartition(parts, *cell).sortWithinPartitions(*cell), _build, "node long, near array<long>")
            union = materialised(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
            joined = cells.join(union, "node", "left").select(*cell, "block", "node", "vec", "rows", "shards", "near")
        found = materialised(map_batches(joined.repartition(parts, *cell).sortWithinPartitions(*cell), _search(least, every), "kind int, node long, value long"))
        counts = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("n"))
        got = {r["node"]: r["n"] for r in counts.where(F.col("node").isin(list(exact))).collect()} if exact else {}
        recall = mean_recall(exact, got)
        if every or (recall is not None and recall >= LEAST_RECALL) or (recall is None and everything):
            break
        every = recall is None or again == AGAIN
        again, overlap = again + 1, overlap * 2
    if every and recall is None and counts.limit(1).count():
        recall = 1.0
    links = found.where("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b"))
    joined = classes.select("node", "rows", "first").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least_id, "component").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = unit.select("id", "node").join(named, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(recall).cast("double")).withColumnRenamed("id", key)
