"""The prefix trie of conversations, by partition refinement.

1. Turns are put in order (turn, null first, then a hash of role and text) by one range exchange over (conversation, turn), so a conversation of any length is spread over
   tasks; the places of turns follow from counts per partition. Texts stay behind there: later steps carry two 64-bit hashes of role and text, and the number of words.
2. Conversations may borrow their first turns: of conversation c - c % family the first h, then their own behind their first h, h = crc32(c) % heads.
3. All conversations are one class, the root. A round splits the active classes by their next turns, STRIDE of them at first and twice as many each round, up to LONGEST: the class
   at each depth is named by its depth and the exclusive or of 128-bit hashes of (place, turn) along the way. A class of one conversation retires: its tail is a chain
   of nodes without branches, which is written from its length alone, without looking at its turns again. Rounds end when no class of two or more goes on.
4. Folding back: a node's leaves and saved tokens are sums over its members of what each stands for: a leaf counts for its smallest member, what a node saves for its smallest
   member too. So one sum per node folds the whole trie, whatever its height; what a node's own smallest member saves above the node is taken off.

No task holds a class or a conversation: groups are summed before the exchange, joins by conversation are dealt by PIECE turns as well, and parents with many
children are joined by broadcast (HOT and a ten-thousandth of all nodes; so there are 10,000 of them at most). The ids that end at a node are
written as runs of text in order, and one task hashes a node's runs as they stream by (SHA-256 has no other way), holding one batch.

Null role and text count as empty. Rows without a conversation id belong to none and take no part. Turns of equal number are ordered by content; equal rows
are turns of their own. Of a table without conversations no trie is made, not even a root. Columns beyond the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, map_batches, materialised, shuffle_partitions, small_batches

STRIDE, LONGEST = 2, 4096
#: Turns of a conversation that are joined together; children from which a node is joined by broadcast.
PIECE, HOT = 1 << 16, 10_000
NODE = ["depth", "n1", "n2"]
c = F.col


def ordered(rows: DataFrame) -> DataFrame:
    """(c, pos, s1, s2, words, total): turns of rows (conv_id, turn, role, text) by place, from 1; total, the turns of the conversation."""
    parts = shuffle_partitions(rows.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("s1"), F.xxhash64(F.lit(1), text, role).alias("s2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    by = ["c", c("turn").asc_nulls_first(), "s1", "s2"]
    dealt = turns.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    told = materialised(dealt.select("c", "s1", "s2", "words", F.monotonically_increasing_id().alias("g"), F.spark_partition_id().alias("part")))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = told.groupBy("c", "part").agg(F.count("*").alias("k"), F.min("g").alias("g0"))
    # a row for each partition that has turns of a conversation
    counts = counts.select("c", "part", "g0", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("b"), F.sum("k").over(Window.partitionBy("c")).alias("total"))
    out = told.join(counts, ["c", "part"]).select("c", (c("b") + c("g") - c("g0") + 1).alias("pos"), "s1", "s2", "words", "total")
    return materialised(out)


def dealt_join(rows: DataFrame, at: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows (c, at) joined with one row per conversation of table (c, len): by pieces of a conversation, so none is joined in one task."""
    pieces = table.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(c("len") / PIECE))))
    return rows.withColumn("_p", F.floor(c(at) / PIECE)).join(pieces, ["c", "_p"], how).drop("_p")


def borrowed(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(c, depth, s1, s2, words) of rebuilt conversations, and (c, len) of each."""
    head = F.crc32(c("c").cast("string")) % heads
    convs = turns.where("pos = 1").select("c", head.alias("h"), (c("c") - c("c") % family).alias("base"), "total")
    lists = turns.where((c("pos") < heads) & (c("c") % family == 0)).groupBy(c("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "s1", "s2", "words"))).alias("t"))
    got = convs.join(lists, "base", "left").withColumn("t", F.when(c("h") > 0, F.slice(F.coalesce("t", F.array().cast("array<struct<pos:bigint,s1:bigint,s2:bigint,words:bigint>>")), F.lit(1), c("h").cast("int"))))
    got = materialised(got.select("c", "h", F.coalesce("t", F.array().cast("array<struct<pos:bigint,s1:bigint,s2:bigint,words:bigint>>")).alias("t"), "total"))
    k = F.size("t").cast("long")
    first = got.select("c", F.explode("t").alias("x")).select("c", c("x.pos").alias("depth"), "x.s1", "x.s2", "x.words")
    own = dealt_join(turns.select("c", "pos", "s1", "s2", "words"), "pos", got.select("c", "h", k.alias("k"), c("total").alias("len"))).where("pos > h")
    own = own.select("c", (c("k") + c("pos") - c("h")).alias("depth"), "s1", "s2", "words")
    return materialised(first.union(own)), materialised(got.select("c", (k + F.greatest(F.lit(0), c("total") - c("h"))).alias("len")))


def refined(turns: DataFrame, lens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rounds of refinement: shared nodes (depth, n1, n2, p1, p2, n, m, words), members (c, depth, n1, n2, len) of classes that were active, and
    retired conversations (c, depth, p1, p2, len): the depth at which each is alone, and its parent there."""
    root = lens.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), "len")
    members = root
    nodes = root.groupBy(*NODE).agg(F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.count("*").alias("n"), F.min("c").alias("m"), F.lit(0).cast("long").alias("words"))
    alone = None
    active, at, stride = root.where("len > 0"), 0, STRIDE
    path = Window.partitionBy("c").orderBy("depth")
    while active.limit(1).count():
        now = turns.where((c("depth") > at) & (c("depth") <= at + stride)).join(active.select("c", "len", c("n1").alias("a1"), c("n2").alias("a2")), "c")
        x1, x2 = F.xxhash64("depth", "s1"), F.xxhash64(F.lit(1), "s2", "depth")
        name = lambda a, x: c(a).bitwiseXOR(F.bit_xor(x).over(path))
        now = now.withColumn("x1", x1).withColumn("x2", x2).withColumn("n1", name("a1", c("x1"))).withColumn("n2", name("a2", c("x2")))
        now = materialised(now.select("c", "depth", "n1", "n2", "len", c("n1").bitwiseXOR(c("x1")).alias("p1"), c("n2").bitwiseXOR(c("x2")).alias("p2"), "words"))
        split = materialised(now.groupBy(*NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n"), F.min("c").alias("m"), F.min("words").alias("words"), F.min("len").alias("len")))
        first = split.where("n = 1").groupBy(c("m").alias("c")).agg(F.min(F.struct("depth", "p1", "p2", "len")).alias("t")).select("c", "t.depth", "t.p1", "t.p2", "t.len")
        first = materialised(first)
        going = now.where(c("depth") == at + stride).join(first.select("c"), "c", "left_anti")
        active = materialised(going.where(c("len") > at + stride).select("c", *NODE, "len"))
        shared = split.where("n > 1").drop("len")
        # beyond the place where a conversation is alone its rows are members of no shared node
        member = now.select("c", *NODE, "len").join(first.select("c", c("depth").alias("f")), "c", "left").where("f is null or depth < f").drop("f")
        nodes, members, alone = nodes.union(shared), members.union(member), first if alone is None else alone.union(first)
        at, stride = at + stride, min(LONGEST, 2 * stride)
    if alone is None:
        alone = root.where("false").select("c", "depth", c("n1").alias("p1"), c("n2").alias("p2"), "len")
    return materialised(nodes), materialised(members), materialised(alone)


def with_parent(rows: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """rows (depth, p1, p2) with parent, the smallest member of the node above; null for the root."""
    up = nodes.select((c("depth") + 1).alias("depth"), c("n1").alias("p1"), c("n2").alias("p2"), c("m").alias("parent"), "n_children")
    key = ["depth", "p1", "p2"]
    hot = materialised(up.where(c("n_children") > limit).drop("n_children"))
    cold = up.where(c("n_children") <= limit).drop("n_children")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, "left"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, n1, n2, c) in order: (depth, n1, n2, first, ids), runs of ids of a node as text."""
    for batch in batches:
        node = [batch.column(k).to_numpy() for k in range(4)]
        if not len(node[0]):
            continue
        new = np.zeros(len(node[0]), bool)
        new[0] = True
        for x in node[:3]:
            new[1:] |= x[1:] != x[:-1]
        begin = np.flatnonzero(new)
        ids = node[3].tolist()
        text = [",".join(map(str, ids[a:b])) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[begin]) for x in node), pa.array(text, pa.string())], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, n1, n2, first, ids) in order: the SHA-256 of each node's runs, joined by commas."""
    now, state = None, None
    give = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in rows], pa.int64()) for i in range(3)), pa.array([h for _, h in rows], pa.string())], names=[*NODE, "ends"])
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield give(done)
    if now is not None:
        yield give([(now, state.hexdigest())])


def ends(members: DataFrame) -> DataFrame:
    """(depth, n1, n2, ends): of each shared node the digest of the conversations that end there."""
    parts = shuffle_partitions(members.sparkSession)
    rows = members.where("depth = len").select(*NODE, "c")
    runs = map_batches(rows.repartitionByRange(parts, *NODE, "c").sortWithinPartitions(*NODE, "c"), _runs, "depth long, n1 long, n2 long, first long, ids string")
    return map_batches(runs.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first"), _digests, "depth long, n1 long, n2 long, ends string")


def above(nodes: DataFrame) -> DataFrame:
    """(depth, n1, n2, above): what nodes above save that have the same smallest member, by pieces of its path."""
    rows = nodes.select(*NODE, "m", "saves", F.floor(c("depth") / PIECE).alias("_p"))
    sums = rows.groupBy("m", "_p").agg(F.sum("saves").alias("s"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("m", "_p", F.coalesce(F.sum("s").over(before("m", "_p")), F.lit(0)).alias("b"))
    inside = rows.withColumn("i", F.coalesce(F.sum("saves").over(before("m", "_p", "depth")), F.lit(0)))
    return inside.join(sums, ["m", "_p"]).select(*NODE, (c("b") + c("i")).alias("above"))


def sha(x: Column) -> Column:
    return F.sha2(F.encode(x, "utf-8"), 256)


def trie(rows: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of conversations
    (conv_id, turn, role, text), rebuilt from families."""
    small_batches(rows.sparkSession)
    turns, lens = borrowed(ordered(rows), family, heads)
    nodes, members, alone = refined(turns, lens)
    # folding back
    up = lambda df: df.where("depth > 0").select((c("depth") - 1).alias("depth"), c("p1").alias("n1"), c("p2").alias("n2"))
    children = up(nodes).union(up(alone)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saves", (c("n") - 1) * c("words"))
    nodes = materialised(nodes)
    stands = nodes.groupBy(c("m").alias("c")).agg(F.sum("saves").alias("saves"), F.max(F.when(c("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    stands = stands.join(alone.select("c", F.lit(1).alias("one")), "c", "full").select("c", F.coalesce("saves", F.lit(0)).alias("saves"), F.greatest(F.coalesce("leaf", F.lit(0)), F.coalesce("one", F.lit(0))).alias("leaf"))
    stands = stands.where("saves > 0 or leaf > 0").join(lens, "c")
    total = dealt_join(members.select("c", *NODE), "depth", stands).groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("total"))
    limit = max(HOT, nodes.count() // 10_000)
    shared = with_parent(nodes, nodes, limit).join(total, NODE).join(above(nodes), NODE).join(ends(members), NODE, "left")
    shared = shared.select(c("m").alias("conv_id"), "depth", c("parent").alias("parent_conv_id"), c("n").alias("n_convs"), "n_children", "n_leaves", (c("total") - c("above")).alias("saved_tokens"), F.coalesce("ends", sha(F.lit(""))).alias("ends_sha256"))
    chain = with_parent(alone, nodes, limit).withColumn("a", F.explode(F.sequence("depth", F.greatest("depth", "len"), F.lit(PIECE).cast("long"))))
    chain = chain.select("c", "len", "parent", c("depth").alias("f"), F.explode(F.sequence("a", F.least(c("a") + PIECE - 1, "len"))).alias("depth"))
    last = c("depth") == c("len")
    chain = chain.select(
        c("c").alias("conv_id"), "depth", F.when(c("depth") == c("f"), c("parent")).otherwise(c("c")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), sha(F.when(last, c("c").cast("string")).otherwise("")).alias("ends_sha256"),
    )
    return shared.union(chain).select(*(c(x).cast("long") if x != "ends_sha256" else c(x) for x in shared.columns))
