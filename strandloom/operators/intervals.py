"""Ordered operators: moving windows, peaks, unions and covers of intervals, cuts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialised

c = F.col


def moving_difference(points: DataFrame, group: str, at: str, value: str, t: int) -> DataFrame:
    """diff: mean of the t rows behind minus mean of the t rows before; 0 where a side has fewer."""
    w = Window.partitionBy(group).orderBy(at)
    back, ahead = w.rowsBetween(-t, -1), w.rowsBetween(1, t)
    whole = (F.count(value).over(back) == t) & (F.count(value).over(ahead) == t)
    return points.withColumn("diff", F.when(whole, F.avg(value).over(ahead) - F.avg(value).over(back)).otherwise(0.0))


def _peaks(at: str, value: str, level: float, apart: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place, height = pdf[at].to_numpy(), pdf[value].abs().to_numpy()
        taken: list[float] = []
        keep = []
        for i in np.lexsort([place, -height]).tolist():
            k = bisect_left(taken, place[i])
            if (k == 0 or place[i] - taken[k - 1] > apart) and (k == len(taken) or taken[k] - place[i] > apart):
                taken.insert(k, place[i])
                keep.append(i)
        return pdf.iloc[sorted(keep)]

    return run


def peaks(points: DataFrame, group: str, at: str, value: str, level: float, apart: float) -> DataFrame:
    """Greedy peaks per group: the largest |value| above level first (ties: smaller place), none within apart of one taken. Only
    candidates above the level reach a group's task."""
    high = points.where(F.abs(c(value)) > level).select(group, at, value)
    return high.groupBy(group).applyInPandas(_peaks(at, value, level, apart), high.schema)


def confirmed(breaks: DataFrame, segments: DataFrame, group: str, at: str, level: float, margin: int, width: int) -> DataFrame:
    """Breaks whose mean depth up to the next breaks on either side, less a margin, differs by more than level."""
    from .aggregates import depth_in_ranges

    w = Window.partitionBy(group).orderBy(at)
    b = breaks.select(group, at).withColumn("_p", F.coalesce(F.lag(at).over(w), F.lit(0))).withColumn("_n", F.lead(at).over(w))
    last = segments.groupBy(group).agg(F.max("end").alias("_last"))
    b = b.join(last, group, "left").withColumn("_n", F.coalesce("_n", "_last"))
    left = b.select(group, at, (c("_p") + margin).alias("rs"), (c(at) - margin).alias("re"))
    right = b.select(group, at, (c(at) + margin).alias("rs"), (c("_n") - margin).alias("re"))
    mean = lambda side, name: side.join(depth_in_ranges(segments, side, group, width), [group, "rs", "re"]).select(group, at, (c("total") / (c("re") - c("rs"))).alias(name))
    return mean(left, "l").join(mean(right, "r"), [group, at]).where(F.abs(c("l") - c("r")) > level).select(group, at)


def union(spans: DataFrame, group: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """Unions of closed intervals that overlap (touching ones stay apart): gaps and islands."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((c(start) >= before + gap).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def cover_fold(spans: Column, tolerance: int = 0) -> Column:
    """A minimal cover of sorted intervals (array of struct start, end), as a fold: of those that start within the cover so far
    (give or take tolerance) the one that reaches furthest. Intervals inside the cover are not used."""
    one, many = "struct<start: bigint, end: bigint>", "array<struct<start: bigint, end: bigint>>"
    nothing = F.lit(None).cast(one)

    def state(done: Column, reach: Column, best: Column) -> Column:
        return F.struct(done.alias("done"), reach.cast("bigint").alias("reach"), best.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        done, reach, best = acc["done"], acc["reach"], acc["best"]
        longer = F.when(x["end"] > F.coalesce(best["end"], reach), x).otherwise(best)
        taken = F.concat(done, F.array(best))
        behind = F.when(x["start"] <= best["end"] + tolerance, state(taken, best["end"], F.when(x["end"] > best["end"], x).otherwise(nothing))).otherwise(state(taken, x["start"], x))
        return F.when(x["start"] <= reach + tolerance, state(done, reach, longer)).when(best.isNotNull(), behind).otherwise(state(done, x["start"], x))

    start = state(F.array().cast(many), F.lit(None), nothing)
    last = lambda acc: F.when(acc["best"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["best"])))
    return F.aggregate(F.array_sort(spans).cast(many), start, step, last)


def running_max(rows: DataFrame, by: list[str], value: str, out: str, group: str = "g") -> DataFrame:
    """rows with out, the largest value of the rows before in the group (null: none), in an order that `by` fixes. Rows are dealt by ranges of group and order, and what
    earlier ranges hold is carried over, so a group of any size is spread over tasks."""
    told = materialised(rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by).withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id()))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    carry = told.groupBy(group, "_p").agg(F.max(value).alias("_m")).select(group, "_p", F.max("_m").over(before(group, "_p")).alias("_c"))
    here = told.withColumn("_h", F.max(value).over(before(group, "_p", "_i")))
    return here.join(carry, [group, "_p"]).withColumn(out, F.greatest("_c", "_h")).drop("_i", "_p", "_c", "_h")


def outer_of_large(spans: DataFrame) -> DataFrame:
    """Intervals (g, s, e) that lie within no other of their group: begins and ends both grow."""
    rows = running_max(spans.distinct().withColumn("x", -c("e")), ["s", "x"], "e", "top")
    return rows.where(c("top").isNull() | (c("e") > c("top"))).select("g", "s", "e")


def cover_by_jumps(spans: DataFrame, tolerance: int = 0) -> DataFrame:
    """A minimal cover (g, s, e) of groups of any size, the same as cover_fold's. Each interval knows the next one of a cover that holds it: the last that begins within its reach,
    else the last that begins with the next interval. Jumps of twice the length come from joining jumps, and those from the first interval mark the cover, longest first:
    a job for each power of two, no array and no task that holds a group."""
    rows = materialised(outer_of_large(spans))
    after = running_max(rows.withColumn("x", -c("s")), ["x"], "x", "n").select("g", "s", "e", (-c("n")).alias("n"))
    # begins, and places at which the last begin up to there is asked for: by reach, behind a gap, and for the first of a group
    begins = rows.select("g", c("s").alias("at"), F.lit(0).alias("kind"), c("s").alias("s"), c("s").alias("v"))
    asks = [(c("e") + tolerance, 1, F.lit(True)), (c("n") + tolerance, 2, c("n").isNotNull())]
    after = materialised(after)
    told = begins
    for at, kind, which in asks:
        told = told.union(after.where(which).select("g", at.alias("at"), F.lit(kind).alias("kind"), "s", F.lit(None).cast("bigint").alias("v")))
    told = told.union(rows.groupBy("g").agg(F.min("s").alias("s")).select("g", (c("s") + tolerance).alias("at"), F.lit(3).alias("kind"), "s", F.lit(None).cast("bigint").alias("v")))
    found = materialised(running_max(told, ["at", "kind", "s"], "v", "to").where("kind > 0").select("g", "s", "kind", "to"))
    jump = found.where("kind < 3").groupBy("g", "s").agg(F.max(F.when(c("kind") == 1, c("to"))).alias("a"), F.max(F.when(c("kind") == 2, c("to"))).alias("b"))
    jump = materialised(jump.select("g", "s", F.when(c("a") > c("s"), c("a")).otherwise(c("b")).alias("to")).where("to is not null"))
    levels = [jump]
    while True:
        last = levels[-1]
        new = materialised(last.join(last.select("g", c("s").alias("to"), c("to").alias("far")), ["g", "to"]).select("g", "s", c("far").alias("to")))
        if not new.limit(1).count():
            break
        levels.append(new)
    marked = materialised(found.where("kind = 3").select("g", c("to").alias("s")))
    for level in reversed(levels):
        marked = materialised(marked.union(marked.join(level, ["g", "s"]).select("g", c("to").alias("s"))))
    return marked.join(rows, ["g", "s"]).select("g", "s", "e")


#: Intervals of a group up to which its cover is folded in one row.
LARGE = 100_000


def minimal_cover(spans: DataFrame, group: str, start: str, end: str, tolerance: int = 0) -> DataFrame:
    """A minimal cover of each group. Intervals within one that begins no later are left out first, by a running maximum, so only the others meet in a row; groups of more than
    LARGE intervals are covered by jumps."""
    size = materialised(spans.groupBy(group).agg(F.count("*").alias("_n")).where(c("_n") > LARGE).select(group))
    rest = spans
    if size.limit(1).count():
        # at most one of LARGE rows names such a group
        rest = spans.join(size, spans[group].eqNullSafe(size[group]), "left_anti")
    before = Window.partitionBy(group).orderBy(c(start), c(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = rest.withColumn("_t", F.max(end).over(before)).where(c("_t").isNull() | (c(end) > c("_t")))
    rows = outer.groupBy(group).agg(F.collect_set(F.struct(c(start).cast("long").alias("start"), c(end).cast("long").alias("end"))).alias("_s"))
    out = rows.select(group, F.explode(cover_fold(c("_s"), tolerance)).alias("_c")).select(group, c("_c.start").alias(start), c("_c.end").alias(end))
    if rest is spans:
        return out
    hot = spans.join(size, spans[group].eqNullSafe(size[group]), "left_semi").select(c(group).alias("g"), c(start).cast("long").alias("s"), c(end).cast("long").alias("e"))
    return out.union(cover_by_jumps(hot, tolerance).select(c("g").alias(group), c("s").alias(start), c("e").alias(end)))


def gaps(cover: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Between neighbours of a cover: (group, from, to, kind gap or overlap)."""
    w = Window.partitionBy(group).orderBy(start, end)
    nxt = cover.withColumn("_n", F.lead(start).over(w)).where("_n is not null")
    return nxt.select(group, F.least(end, "_n").alias("from"), F.greatest(end, "_n").alias("to"), F.when(c("_n") > c(end), "gap").otherwise("overlap").alias("kind"))


def separated(spans: DataFrame, group: str, start: str, end: str, apart: int, running: bool = True) -> DataFrame:
    """Breaks (group, at = start) where an interval begins more than apart behind all before it (running) or the one before it."""
    w = Window.partitionBy(group).orderBy(start, end)
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag(end).over(w)
    return spans.withColumn("_l", last).where(c(start) > c("_l") + apart).select(group, c(start).alias("at"))


def cut(seqs: DataFrame, cuts: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Pieces (name, piece, seq) of sequences at cuts (name, at: 0-based places); places outside are ignored."""
    inner = cuts.groupBy(name).agg(F.array_sort(F.collect_set("at")).alias("_at"))
    out = seqs.join(inner, name, "left")
    n = F.length(seq)
    at = F.concat(F.array(F.lit(0)), F.filter(F.coalesce("_at", F.array().cast("array<int>")), lambda x: (x > 0) & (x < n)).cast("array<int>"), F.array(n))
    return out.withColumn("_p", at).select(name, F.posexplode(F.transform(F.slice("_p", F.lit(1), F.size("_p") - 1), lambda x, i: F.substr(c(seq), x + 1, F.get("_p", i + 1) - x))).alias("piece", seq))


def spaced(points: Column, gap) -> Column:
    """Sorted places of which each is more than gap behind the last one kept, as a fold."""
    kind = "array<bigint>"
    return F.aggregate(F.array_sort(points), F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (x > F.element_at(acc, -1) + gap), F.concat(acc, F.array(x.cast("bigint")))).otherwise(acc))


def successors(hits: DataFrame, ref: str = "ref", at: str = "s1", name: str = "name") -> DataFrame:
    """Neighbours in order of place on a reference: (src, dst)."""
    w = Window.partitionBy(ref).orderBy(at, name)
    return hits.withColumn("_n", F.lead(name).over(w)).where("_n is not null").select(c(name).alias("src"), c("_n").alias("dst"))


def balanced_parts(seqs: DataFrame, parts: int, size: str = "len", order: str = "seq_idx") -> DataFrame:
    """part (0 to parts - 1) of about equal sums of size, in order. Sums over blocks of rows come first, so only block totals are in one window."""
    rows = seqs.withColumn("_b", F.floor(c(order) / 4096))
    total = rows.groupBy("_b").agg(F.sum(size).alias("_t"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_before", F.coalesce(F.sum("_t").over(w), F.lit(0))).withColumn("_all", F.sum("_t").over(Window.partitionBy(F.lit(1))))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(total.drop("_t"), "_b").withColumn("_x", c("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.withColumn("part", F.least(F.lit(parts - 1), F.floor(c("_x") * parts / F.greatest("_all", F.lit(1)))).cast("int")).drop("_b", "_before", "_all", "_x")


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """Assignment by weight, each l and r once: pairs that are best for both sides commit, their rivals go, until none is left.
    This gives what taking pairs by (weight desc, l, r) one at a time gives."""
    from ..plans.runtime import materialised

    rank = lambda k: F.row_number().over(Window.partitionBy(k).orderBy(c("wt").desc(), "l", "r"))
    left, done, n = pairs.select("l", "r", "wt").distinct(), None, None
    while True:
        marked = materialised(left.withColumn("_o", rank("l")).withColumn("_i", rank("r")))
        best = marked.where("_o = 1 and _i = 1").select("l", "r", "wt")
        done = best if done is None else done.union(best)
        left = marked.where("_o > 1 or _i > 1").join(best.select("l"), "l", "left_anti").join(best.select("r"), "r", "left_anti").select("l", "r", "wt")
        n, before = left.count(), n
        if n in (0, before):
            break
    return done
