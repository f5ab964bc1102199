"""Approximate nearest neighbours by largest inner product: a forest of prefix trees over long hash strings.

1. Equal vectors are one class, which carries the k + 1 smallest ids of its rows: no query can list more of them. Inner products become angles: a vector is divided by the
   largest norm and gets one more component, which makes its length 1; a query's is 0.
2. Each of TREES trees gives a vector a hash string of LETTERS letters, each LETTER bits: sides of planes whose normals are differences of sampled vectors and which halve
   the sample (at most SAMPLE vectors are fitted on, by hash). Every vector is indexed.
3. A tree is its sorted strings, cut into leaves by prefixes of variable length: all leaves begin at the length that makes LEAF to 4 * LEAF rows on average; those with more than LIMIT
   rows are split by STEP letters more, as often as it takes; what a whole string can't split is dealt into blocks. Counts of all prefixes are a table.
4. A query descends in each tree to the longest prefix that is there, then ascends in all trees at once, a letter at a time, until the rows below its prefixes
   are as many as the quota. All leaves below are candidates, scored on the original vectors in double precision, summed from the first component to the last. A query whose candidates would be SPENT of all rows or
   more looks at every leaf of the first tree instead, which is exact and no dearer.
5. The quota is calibrated: for AUDIT queries, by hash, the exact neighbours are found by one pass over all vectors, with how many letters they share with the query in each tree; the quota is the least
   power of two at which TARGET of them are met. Recall of the whole search is then measured on those queries; below LEAST_RECALL the quota is four times as large,
   which ends at the latest when every query looks at all. It is a column of the result (null if no query has a candidate).

Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows without an id, which no result could name. Vectors of different
lengths are not compared; of the lengths, the WIDTHS most frequent ones have planes, others are searched whole. All rows that have a query's id are left out for it. If rows share an id, each of them that is a query gives its
20 neighbours, and an id with equal scores is listed once. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialised, small_batches

TREES, LETTER, LETTERS = 4, 2, 30
SAMPLE, WIDTHS = 4000, 64
LEAF, LIMIT, STEP = 1024, 8192, 3
AUDIT, TARGET, LEAST_RECALL, SPENT = 64, 0.95, 0.9, 0.5
#: Queries that meet a leaf at once, and rows of a class from which its results are broadcast (with a ten-thousandth of all rows).
QUERIES_AT_ONCE, HOT = 4096, 10_000
BITS = LETTER * LETTERS
c = F.col


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding): id, node (hash of the vector), vec (doubles) and norm of those that take part."""
    for batch in batches:
        lists = batch.column(1)
        lists = lists.cast(pa.large_list(lists.type.value_type))
        size = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten().cast(pa.float64())
        good = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        x = np.nan_to_num(flat.fill_null(np.nan).to_numpy(), copy=True, nan=np.nan, posinf=np.nan, neginf=np.nan) + 0.0
        good &= ~np.isnan(x)
        end = np.cumsum(size)
        begin = end - size
        sums = lambda v: np.concatenate([[0], np.cumsum(v)])[end] - np.concatenate([[0], np.cumsum(v)])[begin]
        keep = np.flatnonzero((sums(~good) == 0) & (sums(x != 0) > 0) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False))
        data = [x[a:b].tobytes() for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)]
        most = [float(np.abs(x[a:b]).max()) for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)]
        norm = [m * float(np.sqrt(((x[a:b] / m) ** 2).sum())) for m, a, b in zip(most, begin[keep].tolist(), end[keep].tolist(), strict=True)]
        node = [xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in data]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(node, pa.int64()), pa.array(data, pa.binary()), pa.array(norm, pa.float64())], names=["id", "node", "vec", "norm"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def planes(x: np.ndarray, norm: np.ndarray, longest: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Longest norm, normals and offsets of the planes of all letters of all trees."""
    rng = np.random.default_rng(17)
    unit = extended(x, norm, longest)
    a, b = (rng.integers(0, len(unit), TREES * BITS) for _ in range(2))
    normal = unit[a] - unit[b]
    flat = np.linalg.norm(normal, axis=1) < 1e-9
    normal[flat] = rng.normal(size=(int(flat.sum()), unit.shape[1]))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    return longest, normal, np.median(unit @ normal.T, axis=0)


def extended(x: np.ndarray, norm: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))[:, None]], 1)


def strings(models: dict[int, tuple], is_query: bool) -> Callable:
    """Appends codes, the hash string of each tree as a number, to rows (.., vec, norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("vec")
            width, norm = pc.binary_length(batch.column(at)).to_numpy() // 8, batch.column(batch.schema.names.index("norm")).to_numpy()
            out = np.zeros((len(batch), TREES), np.int64)
            for w in np.unique(width):
                if int(w) in models:
                    longest, normal, offset = models[int(w)]
                    rows = np.flatnonzero(width == w)
                    x = matrix(batch.column(at).take(pa.array(rows)))
                    x = np.concatenate([x / norm[rows][:, None], np.zeros((len(x), 1))], 1) if is_query else extended(x, norm[rows], longest)
                    bits = (x @ normal.T > offset).reshape(len(x), TREES, BITS)
                    out[rows] = (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(2)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * TREES), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "codes"])

    return run


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with rows of x, each summed from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the rows that may be among the k best of a query: those that reach its k-th product, but for rounding."""
    us, vs, ss = [], [], []
    size = np.abs(x).sum(1).max() if len(x) else 0
    for a in range(0, len(q), 128):
        s = q[a : a + 128] @ x.T
        least = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(s), -np.inf)
        u, v = np.nonzero(s >= (least - 1e-12 * size * np.abs(q[a : a + 128]).max(1))[:, None])
        us.append(u + a), vs.append(v), ss.append(scores(q[u + a], x[v]))
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ss)


def listed(u: np.ndarray, v: np.ndarray, s: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score, id) of the first k ids of each query, best first."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    taken = ids.take(pa.array(v))
    size = taken.value_lengths().to_numpy()
    flat = taken.flatten().to_numpy()
    u, v, s = np.repeat(u, size), np.repeat(v, size), np.repeat(s, size)
    order = np.lexsort((flat, -s, u))
    u, v, s, flat = u[order], v[order], s[order], flat[order]
    first = np.searchsorted(u, u, "left")
    keep = np.arange(len(u)) - first < k
    return u[keep], v[keep], s[keep], flat[keep]


def _exact(audited: dict[int, tuple], k: int) -> Callable:
    """Of rows (vec, ids, codes): for each audited query its best (q, score, id, shared), shared: letters in common in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = pc.binary_length(batch.column(0)).to_numpy() // 8
            for w in np.unique(width):
                if int(w) not in audited:
                    continue
                names, q, codes = audited[int(w)]
                part = batch.take(pa.array(np.flatnonzero(width == w)))
                u, v, s, ids = listed(*best(q, matrix(part.column(0)), k), part.column(1), k)
                own = part.column(2).flatten().to_numpy().reshape(-1, TREES)
                differ = codes[u] ^ own[v]
                shared = np.full(differ.shape, LETTERS)
                for length in range(LETTERS, 0, -1):
                    shared[(differ >> LETTER * (LETTERS - length)) != 0] = length - 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * TREES), pa.array(shared.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(s), pa.array(ids), lists], names=["q", "score", "id", "shared"])

    return run


def _score(k: int) -> Callable:
    """A leaf's rows (.., vec, ids) and the queries that visit it (.., q, qvec): best (q, score, id) there."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], pa.int64())})
        q, x = matrix(queries.column("qvec").combine_chunks()), matrix(rows.column("vec").combine_chunks())
        u, _, s, ids = listed(*best(q, x, k), rows.column("ids"), k)
        return pa.table({"q": pa.array(queries.column("q").to_numpy()[u]), "score": pa.array(s), "id": pa.array(ids)})

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """(q, near): the k best (score, id) of each query, best first; what several trees found is there once."""
    w = Window.partitionBy("q").orderBy(c("score").desc(), "id")
    rows = found.withColumn("_r", F.dense_rank().over(w)).where(c("_r") <= k).select("q", "score", "id", *(["shared"] if "shared" in found.columns else []), "_r").distinct()
    return rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_r", "score", "id", *(["shared"] if "shared" in found.columns else [])))).alias("near"))


def merged(df: DataFrame) -> DataFrame:
    """A table that grows with the rows, to be joined by merging: its files are small for what they hold, so Spark would send it to the driver and broadcast it."""
    return df.hint("merge")


def prefix(code: str, length) -> F.Column:
    """The first letters of a hash string."""
    return F.expr(f"shiftright({code}, {LETTER} * ({LETTERS} - {length}))")


def leaves(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(node, width, tree, leaf) of every row in every tree, and the leaves (width, tree, length, prefix, n, blocks, first)."""
    key = ["width", "tree", "length", "prefix"]
    begin = 0
    while begin < LETTERS and total >= LEAF * (1 << LETTER) ** (begin + 1):
        begin += 1
    now = rows.select("node", "width", F.posexplode("codes").alias("tree", "code")).withColumn("length", F.lit(begin)).withColumn("prefix", prefix("code", "length"))
    while True:
        size = now.groupBy(*key).agg(F.count("*").alias("n"))
        size = materialised(size.withColumn("blocks", F.when(c("length") >= LETTERS, F.ceil(c("n") / LIMIT)).otherwise(F.lit(1)).cast("int")))
        large = size.where((c("n") > LIMIT) & (c("length") < LETTERS)).select(*key, F.lit(True).alias("split"))
        if not large.limit(1).count():
            size = materialised(numbered(size))
            placed = now.join(merged(size.select(*key, "blocks", "first")), key).withColumn("leaf", c("first") + F.pmod(F.xxhash64("node"), "blocks"))
            return placed.select("node", "width", "tree", "leaf"), size
        deeper = F.when(c("split"), F.least(c("length") + STEP, F.lit(LETTERS))).otherwise(c("length"))
        now = materialised(now.join(merged(large), key, "left").withColumn("length", deeper).withColumn("prefix", prefix("code", "length")).drop("split"))


def numbered(size: DataFrame) -> DataFrame:
    """Leaves with the number of their first block (first), in the order of their strings within a tree: those below any prefix are a range of numbers."""
    w = Window.partitionBy("width", "tree").orderBy(F.expr(f"shiftleft(prefix, {LETTER} * ({LETTERS} - length))")).rowsBetween(Window.unboundedPreceding, -1)
    return size.withColumn("first", F.coalesce(F.sum(c("blocks").cast("long")).over(w), F.lit(0)))


def levels(tree: DataFrame) -> DataFrame:
    """The prefixes of all leaves, each once (some 4/3 of the leaves, not one row per leaf and level): (width, tree, level, at, n rows below, first, last: the leaves below)."""
    rows = tree.withColumn("level", F.explode(F.sequence(F.lit(0), c("length")))).withColumn("at", F.expr(f"shiftright(prefix, {LETTER} * (length - level))"))
    return rows.groupBy("width", "tree", "level", "at").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max(c("first") + c("blocks") - 1).alias("last"))


def ascents(seen: DataFrame, totals: DataFrame, quota: int | None) -> DataFrame:
    """(q, tree, level): how far each query ascends in each tree, given what it has seen (q, width, tree, level, n); tree 0 at level 0 alone if it looks at all."""
    q, at = Window.partitionBy("q"), Window.partitionBy("q", "level")
    rows = seen.repartition("q").withColumn("sum", F.sum("n").over(at)).join(F.broadcast(totals), "width")
    stop = F.max(F.when(c("sum") >= (quota if quota is not None else 1 << 62), c("level"))).over(q)
    rows = rows.withColumn("stop", F.coalesce(stop, F.lit(0)))
    spent = F.max(F.when(c("level") == c("stop"), c("sum"))).over(q)
    rows = rows.withColumn("all", F.coalesce(spent >= c("total") * SPENT, F.lit(True))).where((c("level") <= c("stop")) & (~c("all") | (c("tree") == 0)))
    return rows.groupBy("q", "width", "tree").agg(F.max("level").alias("level"))


def calibrated(truth: dict[int, list], seen: dict[int, list], totals: dict[int, int]) -> int | None:
    """The least power of two as quota at which TARGET of the true neighbours are met; None if it takes a look at all."""
    for power in range(6, 62):
        share, whole = [], True
        for q, near in truth.items():
            sums: dict[int, int] = {}
            deepest: dict[int, int] = {}
            for _, tree, level, n in seen[q]:
                sums[level] = sums.get(level, 0) + n
                deepest[tree] = max(deepest.get(tree, 0), level)
            stop = max((x for x, n in sums.items() if n >= 1 << power), default=0)
            if sums.get(stop, 0) >= totals[seen[q][0][0]] * SPENT:
                share.append(1.0)
                continue
            whole = False
            share.append(float(np.mean([any(shared[t] >= min(stop, deepest.get(t, 0)) for t in range(TREES)) for _, shared in near])))
        if whole:
            return None
        if np.mean(share) >= TARGET:
            return 1 << power
    return None


def nearest(rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query, the rows whose key is divisible by `every`, and the audited recall."""
    spark = rows.sparkSession
    small_batches(spark)
    told = materialised(map_batches(rows.select(c(f"`{key}`").cast("long").alias("id"), c(f"`{column}`").alias("embedding")), vectors, "id long, node long, vec binary, norm double"))
    few = told.select("id", "node").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(c("_r") <= k + 1)
    few = few.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    facts = told.groupBy("node").agg(F.min("vec").alias("vec"), F.min("norm").alias("norm"), F.count("*").alias("rows"), F.min(F.when(c("id") % every == 0, c("id"))).alias("asked"))
    classes = materialised(facts.join(merged(few), "node").withColumn("width", (F.octet_length("vec") / 8).cast("int")))
    widths = classes.groupBy("width").agg(F.count("*").alias("total"), F.max("norm").alias("longest"))
    common = widths.orderBy(c("total").desc(), "width").limit(WIDTHS).collect()
    count = classes.count()
    rate = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 40)) < F.lit(float((1 << 40) * SAMPLE) / max(1, count))
    sample: dict[int, list] = {}
    for r in classes.where(rate & c("width").isin([w.width for w in common])).select("width", "vec", "norm").collect():
        sample.setdefault(r.width, []).append(r)
    longest = {w.width: w.longest for w in common}
    models = {w: planes(np.stack([np.frombuffer(bytes(r.vec), np.float64) for r in s]), np.array([r.norm for r in s]), longest[w]) for w, s in sample.items() if np.isfinite(longest[w])}
    forest = materialised(map_batches(classes.select("node", "width", "vec", "norm", "ids"), strings(models, False), "node long, width int, vec binary, norm double, ids array<long>, codes array<long>"))
    queries = classes.where("asked is not null").select(c("node").alias("q"), "width", "vec", "norm", "asked")
    queries = materialised(map_batches(queries, strings(models, True), "q long, width int, vec binary, norm double, asked long, codes array<long>"))
    placed, tree = leaves(forest, count)
    placed, counts = materialised(placed), materialised(levels(tree))
    deepest = tree.agg(F.max("length")).first()[0] or 0
    steps = queries.select("q", "width", F.posexplode("codes").alias("tree", "code")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("at", prefix("code", "level"))
    steps = materialised(steps.join(merged(counts), ["width", "tree", "level", "at"]).select("q", "width", "tree", "level", "n", "first", "last"))
    # audit
    asked = queries.orderBy(F.xxhash64("q", F.lit(9)), "q").limit(AUDIT).select("q", "width", "vec", "codes", "asked").collect()
    audited = {w: (np.array([r.q for r in asked if r.width == w]), np.stack([np.frombuffer(bytes(r.vec), np.float64) for r in asked if r.width == w]), np.array([r.codes for r in asked if r.width == w], np.int64)) for w in {r.width for r in asked}}
    own = {r.q: r.asked for r in asked}
    exact = map_batches(forest.select("vec", "ids", "codes"), _exact(audited, k + 1), "q long, score double, id long, shared array<int>")
    truth = {r.q: [(x.id, x.shared) for x in r.near if x.id != own[r.q]][:k] for r in top(exact, k + 1).collect()}
    truth = {q: near for q, near in truth.items() if near}
    looked: dict[int, list] = {}
    for r in steps.where(c("q").isin(list(truth))).select("q", "width", "tree", "level", "n").collect() if truth else []:
        looked.setdefault(r.q, []).append((r.width, r.tree, r.level, r.n))
    of_width = {w.width: w.total for w in widths.where(c("width").isin(list(audited))).collect()} if audited else {}
    quota = calibrated(truth, looked, of_width)
    # search; the forest is read by leaves, the queries by what they visit
    leaf = ["width", "tree", "leaf"]
    held = materialised(placed.join(merged(forest.select("node", "vec", "ids")), "node").select(*leaf, "vec", "ids"))
    while True:
        way = ascents(steps.select("q", "width", "tree", "level", "n"), widths.select("width", "total"), quota).join(merged(steps.select("q", "tree", "level", "first", "last")), ["q", "tree", "level"])
        visits = materialised(way.withColumn("leaf", F.explode(F.sequence("first", "last"))).select("q", *leaf))
        met = visits.groupBy(*leaf).agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("parts"))
        left = held.join(merged(met), leaf).withColumn("part", F.explode(F.sequence(F.lit(0), c("parts") - 1))).drop("parts")
        right = visits.join(merged(met), leaf).withColumn("part", F.pmod(F.xxhash64("q", F.lit(2)), "parts").cast("int")).join(merged(queries.select("q", c("vec").alias("qvec"))), "q").select(*leaf, "part", "q", "qvec")
        found = left.groupBy(*leaf, "part").cogroup(right.groupBy(*leaf, "part")).applyInArrow(_score(k + 1), "q long, score double, id long")
        results = materialised(top(found, k + 1))
        got = {r.q: {x.id for x in r.near if x.id != own[r.q]} for r in results.where(c("q").isin(list(truth))).collect()} if truth else {}
        recall = float(np.mean([len(want & got.get(q, set())) / len(want) for q, want in ((q, {i for i, _ in near}) for q, near in truth.items())])) if truth else None
        if recall is None or recall >= LEAST_RECALL or quota is None:
            break
        quota = quota * 4 if quota * 4 < TREES * max(of_width.values()) else None
    # each row that asks takes its class's list without its own id
    limit = max(HOT, count // 10_000)
    hot = materialised(results.join(merged(classes.where(c("rows") > limit).select(c("node").alias("q"))), "q"))
    asks = told.where(c("id") % every == 0).select(c("id").alias("query_id"), c("node").alias("q")).distinct()
    lists = asks.join(F.broadcast(hot), "q").union(asks.join(F.broadcast(hot.select("q")), "q", "left_anti").join(merged(results), "q"))
    others = F.slice(F.filter("near", lambda x: x["id"] != c("query_id")), 1, k)
    out = lists.select("query_id", F.posexplode(others).alias("_r", "x"))
    return out.select("query_id", (c("_r") + 1).cast("int").alias("rank"), c("x.id").alias("vec_id"), c("x.score").alias("score"), F.lit(recall).cast("double").alias("recall"))
