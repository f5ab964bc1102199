"""Near-duplicate documents: a signature-coordinate inverted join, then exact comparison of full shingle sets.

1. Every text becomes its set of word shingles and a MinHash signature. Texts with equal sets are
   one class; only classes go on.
2. Classes are posted under each (coordinate, value) of their signature. Values that only one
   class has leave the lists. A pair must collide in MATCHES coordinates at least (a pair at
   the threshold fails that once in 28 million), so each class needs to be posted only under a prefix:
   its rarest values, all but MATCHES - 1 of them (prefix merging).
3. Posting lists are merged, those of any length: members whose set sizes exclude the threshold are skipped, collisions are
   counted, and pairs with enough are links. A list is searched from one member outwards: those that it collides with leave the
   list and are searched from in turn, so members that collide with one another make no pairs. Long lists are dealt into
   blocks, each pair of blocks being a cell of its own.
4. Families (components of such links) bring their full sets together. Large families are first compared with a few of
   their own members (leaders), one of those not linked so far at a time; what no leader reaches is compared with the whole family, in blocks,
   each pair of blocks in its own cell, searched in the same way. Sets are compared exactly.
   Only spanning links leave a task, so large groups of near copies make no pairs.

Null or empty texts, and texts without words, have no shingles and link with nothing. Rows with one
doc_id and different texts are compared as the texts they are. Null ids never become a component's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, components, map_batches, materialised, mix, randoms, ranges, shuffle_partitions, slice_hashes, small_batches, text_slices, words

COORDINATES, MATCHES = 40, 17
#: Members of a posting list, and of a family, that make a block, and shingles of a family's block.
LIST, BLOCK, BLOCK_SHINGLES = 8192, 1024, 500_000
#: Members that a large family is compared with before its blocks are.
LEADERS = 4
#: Members that are searched from at once.
FRONT = 16
#: Tasks over which a large family is dealt where it meets its leader.
SALTS = 32
A = randoms(COORDINATES, 21) | U64(1)
B = randoms(COORDINATES, 22)
MIX = randoms(64, 23) | U64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind, sorted distinct shingle hashes of all rows, where each row's begin) of lower-cased texts."""
    for row, to, buf, offsets in text_slices(column):
        low = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
        s, e, first = words(low, offsets)
        w = slice_hashes(low, s, e)
        full = max(0, len(w) - size + 1)
        x = np.zeros(full, U64)
        for k in range(size):
            x += mix(w[k : k + full] * MIX[k])
        x = mix(x)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                sets.append(np.unique(x[a : b - size + 1]))
            elif b > a:
                y = U64(b - a)
                for k in range(a, b):
                    y = mix((y + w[k : k + 1]) * MIX[16])[0]
                sets.append(np.array([y], U64))
            else:
                sets.append(np.zeros(0, U64))
        yield row, to, np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _signatures(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, x, start in shingle_sets(batch.column(2), size):
                count = np.diff(start)
                some = np.flatnonzero(count)
                at = start[:-1][some]
                table = np.zeros((to - row, COORDINATES), np.uint32)
                for c in range(COORDINATES if len(some) else 0):
                    table[some, c] = np.minimum.reduceat((x * A[c] + B[c]) >> U64(32), at)
                view = memoryview(x.view(np.uint8))
                prints = np.array([xxhash.xxh3_64_intdigest(view[8 * a : 8 * b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)], U64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row), pa.array(count.astype(np.int64)), pa.array(prints.view(np.int64)),
                    pa.array([v.tobytes() for v in table], pa.binary()),
                ], names=["doc_id", "rk", "n_shingles", "print", "sig"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, key) for each coordinate of (print, sig)."""
    salt = np.arange(COORDINATES, dtype=U64) << U64(32)
    for batch in batches:
        table = _table(batch.column(1))
        key = mix(table.astype(U64) | salt).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(key.ravel())], names=["print", "key"])


def _table(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), COORDINATES)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links x, y: the least node of each one's component."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups from batches sorted by their first columns, of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        edge = np.zeros(len(whole) - 1, bool)
        for k in range(keys):
            v = whole.column(k).to_numpy()
            edge |= v[1:] != v[:-1]
        at = np.flatnonzero(edge)
        if len(at):
            yield whole.slice(0, int(at[-1]) + 1)
            held = [whole.slice(int(at[-1]) + 1)]
        else:
            held = [whole]
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin, and the end."""
    edge = np.zeros(len(columns[0]) - 1, bool)
    for v in columns:
        edge |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(edge) + 1, [len(columns[0])]])


def expand(n: int, near: Callable) -> np.ndarray:
    """For nodes 0 to n - 1: the least node of each one's component. near(x, y) says which of the nodes y are linked with one of x;
    nodes are searched from one after the other, and those found are left out of later searches."""
    label, left = np.arange(n), np.arange(n)
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = near(front[:FRONT], left)
            label[left[hit]] = root
            front, left = np.concatenate([front[FRONT:], left[hit]]), left[~hit]
    return label


def _stars(names: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    more = label != np.arange(len(names))
    return pa.RecordBatch.from_arrays([pa.array(names[more]), pa.array(names[label[more]])], names=["a", "b"])


def _distinct(names: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places a to b - 1, one for each name."""
    return a + np.sort(np.unique(names[a:b], return_index=True)[1])


def _merge(num: int, den: int) -> Callable:
    """Posting lists (key, i, j, print, n, sig) sorted by the first three: candidate links, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 3, 20_000):
            key, i, j, name, n = (batch.column(k).to_numpy() for k in range(5))
            table = _table(batch.column(5))
            nodes, of = np.unique(name, return_inverse=True)
            xs, ys = [], []
            edge = bounds(key, i, j)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                size, sig = n[a:b], table[a:b]

                def near(x: np.ndarray, y: np.ndarray, size=size, sig=sig) -> np.ndarray:
                    out = np.zeros(len(y), bool)
                    for k in x.tolist():
                        fits = np.flatnonzero(~out & (den * np.minimum(size[k], size[y]) >= num * np.maximum(size[k], size[y])))
                        out[fits[(sig[y[fits]] == sig[k]).sum(1) >= MATCHES]] = True
                    return out

                label = expand(b - a, near)
                more = np.flatnonzero(label != np.arange(b - a))
                xs.append(of[a + more]), ys.append(of[a + label[more]])
            if xs:
                yield _stars(nodes, forest(len(nodes), np.concatenate(xs), np.concatenate(ys)))

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, x, start in shingle_sets(batch.column(3), size):
                data = pa.Array.from_buffers(pa.large_binary(), to - row, [None, pa.py_buffer((8 * start).astype(np.int64)), pa.py_buffer(x.view(np.uint8))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, to - row) for k in range(3)), data], names=["family", "blocks", "print", "set"])

    return run


def exact_forest(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least set of each one's component under links den * |both| >= num * |any|; sets of one side are not compared, unless it is 0."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    end, mark = start + size, np.zeros(len(names), bool)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), bool)
        for k in x.tolist():
            fits = np.flatnonzero(~out & ((side[k] == 0) | (side[y] != side[k])) & (den * np.minimum(size[k], size[y]) >= num * np.maximum(size[k], size[y])))
            if not len(fits):
                continue
            mine = at[start[k] : end[k]]
            mark[mine] = True
            z = y[fits]
            both = np.add.reduceat(mark[at[ranges(start[z], size[z])]], np.cumsum(size[z]) - size[z], dtype=np.int64)
            mark[mine] = False
            out[fits[den * both >= num * (size[k] + size[z] - both)]] = True
        return out

    return expand(len(sets), near)


def _confirm(num: int, den: int) -> Callable:
    """Sets (family, i, j, print, side, set) sorted by the first three: links (a, b) of prints, as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, 3, 2000):
            family, i, j, name, side = (batch.column(k).to_numpy() for k in range(5))
            edge = bounds(family, i, j)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                at = _distinct(name, a, b)
                if len(at) > 1:
                    yield _stars(name[at], exact_forest([np.frombuffer(x, U64) for x in batch.column(5).take(pa.array(at)).to_pylist()], side[at], num, den))

    return run


def _led(num: int, den: int) -> Callable:
    """(print, set, leader, leader's set): those that are linked with their leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = ([np.frombuffer(x, U64) for x in batch.column(k).to_pylist()] for k in (1, 3))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(p, q, strict=True)], np.int64)
            every = np.array([len(x) + len(y) for x, y in zip(p, q, strict=True)], np.int64) - both
            hit = pa.array(den * both >= num * every)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(2).filter(hit)], names=["a", "b"])

    return run


def family_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that span the components of sets (family, blocks, print, set), comparing within families only."""
    parts = shuffle_partitions(sets.sparkSession)
    cell = ["family", "i", "j"]
    schema = "a long, b long"
    small = sets.where("blocks = 1").select("family", F.lit(0).alias("i"), F.lit(0).alias("j"), "print", F.lit(0).alias("side"), "set")
    large = sets.where("blocks > 1")
    found = None
    if large.limit(1).count():
        for _ in range(LEADERS):
            # the least of those in each family that no leader has reached
            open_ = large if found is None else large.join(found.select(F.explode(F.array("a", "b")).alias("print")).distinct(), "print", "left_anti")
            leader = open_.groupBy("family").agg(F.min(F.struct(F.xxhash64("print").alias("h"), "print", "set")).alias("x")).select("family", F.col("x.print").alias("leader"), F.col("x.set").alias("leader_set"))
            dealt = large.withColumn("_s", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int"))
            both = dealt.join(leader.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["family", "_s"])
            more = materialised(map_batches(both.select("print", "set", "leader", "leader_set"), _led(num, den), schema))
            if not more.limit(1).count():
                break
            found = more if found is None else found.union(more)
        # a leader is linked with itself, so what is left was never reached, and is compared with all of its family
        label = components(found.where("a <> b")).withColumnRenamed("node", "print")
        known = large.join(label, "print", "left").withColumn("label", F.coalesce("component", "print"))
        most = known.groupBy("family", "label").agg(F.count("*").alias("k")).groupBy("family").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("family", F.col("m.label").alias("main"))
        rest = known.join(most, "family").withColumn("is_main", F.col("label") == F.col("main"))
        rest = materialised(rest.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")).select("family", "blocks", "print", "set", "block", "is_main"))
        # cells: each block of those outside the largest component with every block of it, and with one another
        others = rest.where("not is_main").groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("others"))
        rest = rest.join(others, "family").withColumn("own", F.pmod(F.xxhash64("print"), F.col("others")).cast("int"))
        mains = rest.where("is_main").select("family", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), (F.col("block") + 1).alias("j"), "print", F.lit(1).alias("side"), "set")
        each = rest.where("not is_main")
        with_mains = each.select("family", F.col("own").alias("i"), F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("j"), "print", F.lit(2).alias("side"), "set")
        among = each.select("family", "own", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o"), "print", "set").select("family", (-1 - F.least("own", "o")).alias("i"), (-1 - F.greatest("own", "o")).alias("j"), "print", F.lit(0).alias("side"), "set")
        small = small.unionByName(mains).unionByName(with_mains).unionByName(among)
    links = map_batches(small.repartition(parts, *cell).sortWithinPartitions(*cell), _confirm(num, den), schema)
    return links if found is None else links.union(found.where("a <> b"))


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs, one row of each component of near duplicates."""
    chosen = near_duplicates(docs, shingle, percent, key, column).where("representative").groupBy("rk").agg(F.max("n_shingles").alias("n"))  # null ids and texts included
    rows = docs.select(F.struct(*(docs[n] for n in docs.columns)).alias("row"), F.xxhash64(docs[key], docs[column]).alias("rk"))
    kept = rows.join(chosen.hint("shuffle_hash"), "rk")
    # of equal rows, which share rk, one stays: all are numbered within their partition of rk
    number = F.row_number().over(Window.partitionBy("rk").orderBy("n"))
    return kept.withColumn("number", number).where("number = 1").select(*(F.col("row")[n].alias(n) for n in docs.columns))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, rk (hash of key and text), n_shingles, component_id (smallest key reachable by links), kept and representative of each
    row; links are pairs with 100 * |both| >= percent * |any| on shingles of so many words. kept goes by key; representative
    marks one text of each component, also where rows share a key."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    num, den = percent, 100
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[key], docs[column]).alias("rk"), docs[column].alias("text"))
    signed = materialised(map_batches(rows, _signatures(shingle), "doc_id long, rk long, n_shingles long, print long, sig binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk"))
    classes = materialised(signed.where("n_shingles > 0").groupBy("print").agg(least.alias("m"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    # posting lists, and the prefix of each class
    posted = map_batches(classes.select("print", "sig"), _postings, "print long, key long")
    common = posted.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    mine = posted.join(common, "key").groupBy("print").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("k")).where(F.size("k") >= MATCHES)
    prefix = materialised(mine.select("print", F.explode(F.expr(f"slice(k, 1, size(k) - {MATCHES - 1})")).alias("k")).select("k.key", "k.f", "print"))
    # a list of several blocks: each member comes to the cells of its own block with every other one
    lists = prefix.withColumn("lists", F.ceil(F.col("f") / LIST).cast("int")).withColumn("own", F.pmod(F.xxhash64("print", F.lit(7)), F.col("lists")).cast("int"))
    cells = lists.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "print")
    posted = cells.join(classes.select("print", "n", "sig"), "print").select("key", "i", "j", "print", "n", "sig")
    edges = map_batches(posted.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j"), _merge(num, den), "a long, b long")
    families = materialised(components(edges).withColumnRenamed("node", "print").withColumnRenamed("component", "family"))
    # exact comparison
    member = families.join(classes.select("print", "n", "m"), "print").select("family", "print", "n", F.col("m.rk").alias("rk"), F.col("m.doc_id").alias("doc_id"))
    size = member.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = member.join(size, "family").select("family", "blocks", "print", F.col("rk").alias("r"), F.col("doc_id").alias("d"))
    texts = rows.join(member.hint("shuffle_hash"), (F.col("rk") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("family", "blocks", "print", "text")
    sets = materialised(map_batches(texts, _sets(shingle), "family long, blocks int, print long, set binary"))
    links = materialised(family_links(sets, num, den))
    found = components(links).withColumnRenamed("node", "print")
    # smallest id of each component, and of each class
    first = F.min("m")
    known = classes.join(found, "print", "left").where("n_rows > 1 or component is not null").withColumn("component", F.coalesce("component", "print"))
    top = known.groupBy("component").agg(first.alias("first")).select("component", F.col("first.doc_id").alias("component_id"), F.col("first.rk").alias("first_rk"))
    named = known.join(top, "component").select("print", "component_id", "first_rk")
    out = signed.select("doc_id", "rk", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print")).join(named, "print", "left")
    out = out.select("doc_id", "rk", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("first_rk") == F.col("rk"), F.lit(True)).alias("representative"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("doc_id", key)
