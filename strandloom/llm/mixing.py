"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: weights share a budget of words; a target stops at a multiple of its source's size, and what
exceeds that is shared again by weight until none is above (one level, found by prefix sums over sources).

Draws: the documents of a source are dealt into blocks by hash, so many that a block has about BLOCK_ROWS of all rows at most, and its blocks are permuted. A
source's target is so many whole passes over its blocks plus a part of one more pass, which ends
within a block, at the document whose middle passes the target. So a source has an exact
quota of blocks. A tree over the output shards splits all sources' quotas: at each node the
left half of the shards gets a multivariate-hypergeometric share of the node's blocks. A shard
then takes the next blocks of each source's permutation, disjoint from all other shards', and is shuffled
locally by hash. The tree has one number per source and shard and runs on the driver, which is its bound on the number of sources
(some ten thousand times the shards of a job); everything with a row per block or document is DataFrame code on rows without text.

All draws are functions of seed and keys, so reruns agree. Null text has size 0; documents of size 0 are in a draw like
others but add no words; null is a source of its own, last in order; repeated rows with equal key and text are drawn alike.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialised, shared_folder, shuffle_partitions

#: Blocks at least, and rows of a block if there are more.
BLOCKS, BLOCK_ROWS = 1024, 1 << 16
#: Numbers of the tree that are written in one job.
SHARES = 100_000
SEED = 20


def hypergeometric(total: int, good: int, drawn: int, rng: random.Random) -> int:
    """How many of good items are among drawn ones of total, by inversion from the least possible number up."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    u, x, below = rng.random(), low, 0.0
    while x < high:
        below += math.exp(choose(good, x) + choose(total - good, drawn - x) - choose(total, drawn))
        if u < below:
            break
        x += 1
    return x


def split(quota: Sequence[int], shards: int, seed: str) -> list[list[int]]:
    """quota of each source split among shards: for each shard a list over sources."""
    if shards == 1:
        return [list(quota)]
    rng = random.Random(seed)
    half = shards // 2
    rest = sum(quota)
    places = rest * half // shards
    left = []
    for k in quota:
        x = hypergeometric(rest, k, places, rng) if rest else 0
        left.append(x)
        rest, places = rest - k, places - x
    right = [k - x for k, x in zip(quota, left, strict=True)]
    return split(left, half, f"{seed}l") + split(right, shards - half, f"{seed}r")


def sized(docs: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """Rows without text: id, rk, source, size."""
    rk = F.xxhash64(docs[key], docs[column])
    return docs.select(docs[key].alias("id"), rk.alias("rk"), docs[source].alias("source"), F.coalesce(F.regexp_count(docs[column], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def block_count(rows: int) -> int:
    """A power of two that goes by the number of rows alone, so that neither reruns nor the cluster's settings change a draw."""
    return max(BLOCKS, 1 << (rows // BLOCK_ROWS).bit_length())


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """source, source_size, target for (source, source_size); a row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    out = sizes.withColumn("w", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    cap = most * F.col("source_size")
    by_cap = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = budget * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    share = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    out = out.withColumn("level", left / share)
    # sources are capped in this order, while a cap is below the level that the others leave
    out = out.withColumn("final", F.min(F.when(F.col("w") * F.col("level") <= cap, F.struct(F.col("source_size") / F.col("w"), F.col("level")))).over(every)["level"])
    return out.select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("w") * F.col("final"), cap.cast("double"))).alias("target"))


def _shares(spark: SparkSession, shares: Sequence[tuple[str | None, list[int]]]) -> DataFrame:
    """(s, shard, at): the places in a source's sequence of blocks that each shard takes, from what each takes of it."""
    path = shared_folder(spark)
    kind = "array<struct<s: string, ends: array<bigint>>>"
    several = max(1, SHARES // max(1, len(shares[0][1]))) if shares else 1
    for k in range(0, max(1, len(shares)), several):  # some sources at a time, as text in a small job of its own
        text = json.dumps([{"s": s, "ends": list(accumulate(x))} for s, x in shares[k : k + several]])
        rows = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(text), kind)).alias("x")).select("x.s", F.posexplode("x.ends").alias("shard", "high"), "x.ends")
        rows.select("s", "shard", F.coalesce(F.get("ends", F.col("shard") - 1), F.lit(0)).alias("low"), "high").where("low < high").write.mode("append").parquet(path)
    return spark.read.schema("s string, shard int, low long, high long").parquet(path).select("s", "shard", F.explode(F.expr("sequence(low, high - 1)")).alias("at"))


def allocate(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: int = 2, shards: int | None = None, key: str = "doc_id", column: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """A row per document: id, rk, size, source_size, target, taken, and draws (array of shard and place, one for each time it is taken)."""
    spark = docs.sparkSession
    shards = shards or shuffle_partitions(spark)
    rows = materialised(sized(docs, key, column, source), shuffle_partitions(spark))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rk", F.lit(seed)), F.lit(block_count(rows.count()))).cast("int"))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    per_source = blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
    goal = targets(per_source.select("source", "source_size"), weights, budget, most)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    goal = goal.join(per_source.select(F.col("source").alias("s"), "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("passes", passes.cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    placed = blocks.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("start", F.sum("words").over(permuted) - F.col("words"))
    g = goal.withColumnRenamed("source", "s")
    placed = materialised(placed.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s", "words"))
    quota = placed.groupBy("source").agg((F.max("n_blocks") * F.max("passes") + F.sum((F.col("start") < F.col("rest")).cast("int"))).cast("long").alias("k"))
    quota = sorted(((r["source"], r["k"]) for r in quota.collect()), key=lambda x: (x[0] is None, x[0] or ""))
    dealt = split([k for _, k in quota], shards, str(seed))
    # the places in a source's sequence of blocks that each shard takes: a row per place
    plan = _shares(spark, [(name, [shard[i] for shard in dealt]) for i, (name, _) in enumerate(quota)])
    turns = placed.select("source", "block", "rank", "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("t")).withColumn("place", F.col("t") * F.col("n_blocks") + F.col("rank"))
    taken = turns.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("at"))).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("t", "shard"))).alias("k"))
    taken = taken.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("k.shard").alias("shards"))
    placed = placed.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("rk", F.lit(seed + 2)), "rk", "id")
    docs_in = rows.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    p = placed.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    out = docs_in.join(p, (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "b")
    once_more = F.col("start") + F.col("before") + F.col("size") / 2 <= F.col("rest")
    out = out.withColumn("times", F.col("passes") + (once_more & (F.col("passes") < most)).cast("int"))
    draw = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda t: t < F.col("times")),
        lambda t: F.struct(
            F.coalesce(F.get("shards", t), F.pmod(F.xxhash64("rk"), F.lit(shards)).cast("int")).alias("shard"),  # rows without words, behind the last block
            F.xxhash64("rk", t, F.lit(seed + 3)).alias("place"),
        ),
    )
    return out.select("id", "rk", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), draw.alias("draws")).withColumnRenamed("id", key)


def mix(docs: DataFrame, shards: int | None = None, key: str = "doc_id", column: str = "text", allocated: DataFrame | None = None, **options) -> DataFrame:
    """The mixed documents: columns of docs, a row for each time that a document is taken. A shard is a partition, shuffled
    within; there are as many as shuffle partitions unless shards says otherwise. allocated: what allocate returned for docs, if known."""
    shards = shards or shuffle_partitions(docs.sparkSession)
    allocated = allocate(docs, shards=shards, key=key, column=column, **options) if allocated is None else allocated
    drawn = allocated.where(F.size("draws") > 0).select("rk", "draws").dropDuplicates(["rk"])
    rows = docs.select(F.struct(*(docs[n] for n in docs.columns)).alias("row"), F.xxhash64(docs[key], docs[column]).alias("rk"))
    each = rows.join(drawn.hint("shuffle_hash"), "rk").select("row", F.explode("draws").alias("d"))
    mixed = each.repartitionById(shards, F.col("d.shard")).sortWithinPartitions("d.place")
    return mixed.select(*(F.col("row")[n].alias(n) for n in docs.columns))


def mixed_amounts(docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """As allocate, but taken is counted in the texts that mix returns."""
    each = materialised(allocate(docs, key=key, column=column, **options))
    mixed = mix(docs, key=key, column=column, allocated=each)
    words = F.coalesce(F.regexp_count(mixed[column], F.lit(WORD)), F.lit(0))
    found = mixed.select(F.xxhash64(mixed[key], mixed[column]).alias("rk"), words.alias("w")).groupBy("rk").agg(F.sum("w").alias("words"))
    copies = each.groupBy("rk").agg(F.count("*").alias("k"))  # equal rows are drawn alike
    taken = copies.join(found, "rk").select("rk", F.expr("words div k").alias("taken"))
    return each.drop("taken").join(taken, "rk", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
