"""Break model of misassemblies: breakpoints of repeats, hidden ones, clusters, candidate cuts, and the test of counts.

End codes: 0 and 1 begin and end the copy on ref, 2 and 3 that on qry; -2 - code marks a projected point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import group_count_test
from ..plans.runtime import materialised
from ..schemas import CLUSTER_APART, EXACT_CHOICES, HIDDEN_APART, MARK
from .graph import components

c = F.col


def natural(aln: DataFrame) -> DataFrame:
    """Four breakpoints for each alignment row with a number rep; clusters 2 rep and 2 rep + 1 join what the match aligns."""
    turned = c("s2") >= c("e2")

    def point(k, endpt, cluster, contig, loc):
        return F.struct((c("rep") * 4 + k).alias("key"), c("rep"), endpt.cast("int").alias("endpt"), (c("rep") * 2 + cluster).alias("cluster"), c(contig).alias("contig"), c(loc).alias("loc"))

    points = F.array(point(0, F.lit(0), 0, "ref", "s1"), point(1, F.lit(1), 1, "ref", "e1"), point(2, F.when(turned, 3).otherwise(2), 0, "qry", "s2"), point(3, F.when(turned, 2).otherwise(3), 1, "qry", "e2"))
    return aln.select(F.explode(points).alias("p")).select("p.*")


def copies(points: DataFrame) -> DataFrame:
    """Both copies of each repeat: rep, copy (0 on ref, 1 on qry), contig, lo, hi, and whether qry's is reversed."""
    side = points.withColumn("copy", (c("endpt") >= 2).cast("int"))
    out = side.groupBy("rep", "copy", "contig").agg(F.min("loc").alias("lo"), F.max("loc").alias("hi"), F.min_by("cluster", F.struct("loc", "key")).alias("first"))
    return out.join(out.groupBy("rep").agg((F.count_distinct("first") > 1).alias("turned")), "rep").drop("first")


def enclosed(points: DataFrame, width: int = 10_000) -> DataFrame:
    """Points within each copy of each repeat, ends included (range join by bins): in_rep, copy, lo, hi, turned and the point's columns."""
    bins = copies(points).select(c("rep").alias("in_rep"), "copy", c("contig").alias("on"), "lo", "hi", "turned", F.explode(F.sequence(F.floor(c("lo") / width), F.floor(c("hi") / width))).alias("bin"))
    return points.join(bins, (c("contig") == c("on")) & (F.floor(c("loc") / width) == c("bin")) & (c("loc") >= c("lo")) & (c("loc") <= c("hi"))).drop("on", "bin")


#: Widths of a bin of running sums; rows that Python holds at once, but for those of one bin.
WIDTHS_OF_BIN, ROWS_AT_ONCE = 64, 1 << 18


def enclosed_totals(points: DataFrame, value: Column, width: int = 10_000) -> DataFrame:
    """(in_rep, copy, n, s): number of the points that enclosed() gives for a copy, and their sum of value (a whole number; null if it has none). Sums run along the contig, so
    no pair is made: a copy has what was summed at its end less what was before its begin."""
    side = (c("endpt") >= 2).cast("int").alias("copy")
    return _totals(points.repartition("rep").select("rep", side, "contig", F.array(F.struct("loc", value.cast("long").alias("v"))).alias("at")), width)


def enclosed_totals_of(aln: DataFrame, value: Callable[[Column], Column], width: int = 10_000) -> DataFrame:
    """enclosed_totals of natural(aln), with value a function of a point's key; an alignment is sent once, not as its four points."""

    def half(copy, contig, *ends):
        return F.struct(F.lit(copy).alias("copy"), c(contig).alias("contig"), F.array(*(F.struct(c(loc).alias("loc"), value(c("rep") * 4 + 2 * copy + k).cast("long").alias("v")) for k, loc in enumerate(ends))).alias("at"))

    rows = aln.select("rep", "s1", "e1", "s2", "e2", "ref", "qry").repartition("rep")
    return _totals(rows.select("rep", F.explode(F.array(half(0, "ref", "s1", "e1"), half(1, "qry", "s2", "e2"))).alias("h")).select("rep", "h.*"), width)


def _totals(parts: DataFrame, width: int) -> DataFrame:
    """Totals of copies given by parts (rep, copy, contig, at: points as (loc, v)), where rows of a rep are in one task. A copy is sent to the bins of its points, with these points alone, and is
    counted there; one of several bins gets what earlier bins of the contig hold by its begin and by its end. Bins have WIDTHS_OF_BIN widths, so most copies lie in one."""
    span = int(width) * WIDTHS_OF_BIN
    bin_of = lambda x: F.floor(x / span)
    parts = parts.withColumn("at", F.filter("at", lambda x: x["loc"].isNotNull())).where("contig is not null and size(at) > 0")
    own = parts.select("contig", F.explode("at").alias("x")).groupBy("contig", bin_of(c("x.loc")).alias("bin")).agg(F.count("*").alias("n"), F.coalesce(F.sum("x.v"), F.lit(0)).alias("s"), F.count("x.v").alias("m"))
    before = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select("contig", "bin", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in ("n", "s", "m")))
    carry = carry.select("contig", "bin", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("int").alias("copy"), F.lit(-1).cast("byte").alias("ends"), F.array().cast("array<long>").alias("loc"), F.array("n", "s", "m").alias("v"))
    both = parts.groupBy("rep", "copy", "contig").agg(F.flatten(F.collect_list("at")).alias("at"))
    both = both.withColumn("lo", bin_of(F.array_min("at.loc"))).withColumn("hi", bin_of(F.array_max("at.loc")))
    within = c("lo") == c("hi")
    both = both.withColumn("bin", F.explode(F.when(within, F.array("lo")).otherwise(F.array_distinct(F.transform("at.loc", bin_of)))))
    both = both.withColumn("at", F.when(within, c("at")).otherwise(F.filter("at", lambda x: bin_of(x["loc"]) == c("bin"))))
    ends = (F.when(c("lo") == c("bin"), 1).otherwise(0) + F.when(c("hi") == c("bin"), 2).otherwise(0)).cast("byte")
    both = both.select("contig", "bin", c("rep").cast("long").alias("rep"), "copy", ends.alias("ends"), F.transform("at.loc", lambda x: (x - c("bin") * span).cast("long")).alias("loc"), c("at.v").alias("v"))
    group = ["contig", "bin"]
    rows = both.union(carry).repartition(*group).sortWithinPartitions(F.xxhash64(*group), *group)
    counted = rows.mapInArrow(_counted(span), "in_rep long, copy int, n long, s long, m long")
    got = counted.groupBy("in_rep", "copy").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m").alias("m"))
    return got.where("n > 0").select("in_rep", "copy", "n", F.when(c("m") > 0, c("s")).alias("s"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (contig, bin) of rows in order, of ROWS_AT_ONCE rows or of one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = _first_rows(batch)
        last = int(new[-1])
        fresh = held and any(batch.column(k)[0] != held[-1].column(k)[len(held[-1]) - 1] for k in (0, 1))
        if held and (fresh or last) and sum(map(len, held)) + last >= ROWS_AT_ONCE:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _first_rows(rows) -> np.ndarray:
    """Places of rows whose contig or bin differs from that of the row before."""
    change = np.zeros(len(rows), bool)
    change[:1] = True
    for k in (0, 1):
        x = rows.column(k)
        change[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _counted(span: int) -> Callable:
    """Of rows (contig, bin, rep, copy, ends, loc, v) in groups: for each copy (rep, copy, n, s, m) in all if it has both ends in the bin (ends 3), else its end's sums (2) or its
    begin's with a minus (1), what earlier bins hold included, which a row of its own (-1) says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            rows = rows.combine_chunks()
            first = _first_rows(rows)
            group = np.repeat(np.arange(len(first)), np.diff(first, append=len(rows)))
            ends, lists, values = rows.column("ends").to_numpy(), rows.column("loc").combine_chunks(), rows.column("v").combine_chunks()
            carry = np.zeros((len(first), 3), np.int64)
            told = ends < 0
            carry[group[told]] = values.filter(pa.array(told)).flatten().to_numpy().reshape(-1, 3)
            real = np.flatnonzero(~told)
            if not len(real):
                continue
            at, group, ends = pa.array(real), group[real], ends[real]
            lists, flat = lists.take(at), values.take(at).flatten()
            size = lists.value_lengths().to_numpy().astype(np.int64)
            key = np.repeat(group * span, size) + lists.flatten().to_numpy()
            begin = np.cumsum(size) - size
            lo, hi = np.minimum.reduceat(key, begin), np.maximum.reduceat(key, begin)
            order = np.argsort(key)
            key = key[order]
            sums = [np.concatenate([[0], np.cumsum(x[order])]) for x in (flat.fill_null(0).to_numpy(), flat.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))]
            a, b, zero = (np.searchsorted(key, x, way) for x, way in ((lo, "left"), (hi, "right"), (group * span, "left")))
            a, b = np.where(ends & 1, a, zero), np.where(ends & 2, b, zero)
            # ends 2: b - zero + carry; ends 1: zero - a - carry
            sign = np.where(ends == 2, 1, np.where(ends == 1, -1, 0))
            out = [b - a + sign * carry[group, 0], *(x[b] - x[a] + sign * carry[group, k] for k, x in enumerate(sums, 1))]
            some = np.flatnonzero(ends > 0)
            names = [rows.column(k).combine_chunks().take(pa.array(real[some])) for k in ("rep", "copy")]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(x[some]) for x in out)], names=["in_rep", "copy", "n", "s", "m"])

    return run


#: Copies of a group that one task looks at.
COPIES = 65_536


def _projected(apart: int) -> Callable:
    """Copies (lo, hi, turned, to, to_lo, to_hi) of a group and the points among which theirs are (rep, cluster, endpt, loc, members: places of the points that
    the match aligns, itself included): (rep, endpt, cluster, contig, loc) of points to show. A copy at a time, so pairs are not kept."""

    def run(both: pa.Table, points: pa.Table) -> pa.Table:
        schema = pa.schema([("rep", pa.int64()), ("endpt", pa.int32()), ("cluster", pa.int64()), ("contig", pa.string()), ("loc", pa.int32())])
        if not len(both) or not len(points):
            return schema.empty_table()
        rep, cluster, endpt, loc = (points.column(k).to_numpy().astype(np.int64) for k in ("rep", "cluster", "endpt", "loc"))
        lists = points.column("members").combine_chunks()
        size = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten()
        name, to = flat.field("contig").to_pylist(), both.column("to").to_pylist()
        number = {n: k for k, n in enumerate(dict.fromkeys(to))}
        begin = np.cumsum(size) - size
        most = int(size.max())
        on, at = np.full((most, len(loc)), -1), np.zeros((most, len(loc)), np.int64)
        names, places = np.array([number.get(n, -1) for n in name], np.int64), flat.field("loc").to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(most):
            has = np.flatnonzero(size > k)
            on[k, has], at[k, has] = names[begin[has] + k], places[begin[has] + k]
        shown = -2 - endpt
        ways = []
        for sign in (1, -1):
            order = np.lexsort((cluster, shown, rep, sign * loc))
            ways.append((order, sign * loc[order], on[:, order], at[:, order]))
        lo, hi, to_lo, to_hi = (both.column(k).to_numpy().astype(np.int64) for k in ("lo", "hi", "to_lo", "to_hi"))
        turned, target = both.column("turned").to_pylist(), [number[n] for n in to]
        rows, where, place = [], [], []
        for i in range(len(both)):
            order, key, on, at = ways[int(turned[i])]
            a, b = (np.searchsorted(key, -hi[i], "left"), np.searchsorted(key, -lo[i], "right")) if turned[i] else (np.searchsorted(key, lo[i], "left"), np.searchsorted(key, hi[i], "right"))
            there = np.zeros(b - a, bool)
            for k in range(most):
                there |= (on[k, a:b] == target[i]) & (at[k, a:b] >= to_lo[i]) & (at[k, a:b] <= to_hi[i])
            missing = np.flatnonzero(~there)
            # keys grow in the order of the other copy, mirrored ones as well
            x = key[a:b][missing] + (hi[i] if turned[i] else -lo[i]) + to_lo[i]
            far = np.flatnonzero((np.abs(np.diff(x, prepend=to_lo[i])) >= apart) & (np.abs(to_hi[i] - x) >= apart))
            rows.append(order[a:b][missing[far]]), place.append(x[far]), where.append(np.full(len(far), i))
        r, i = np.concatenate(rows), np.concatenate(where)
        out = [pa.array(rep[r]), pa.array(shown[r].astype(np.int32)), pa.array(cluster[r]), both.column("to").combine_chunks().take(pa.array(i)), pa.array(np.concatenate(place).astype(np.int32))]
        return pa.Table.from_arrays(out, schema=schema)

    return run


def projected(points: DataFrame, apart: int, width: int) -> DataFrame:
    """(rep, endpt, cluster, contig, loc) of the points that a copy has and the other lacks, on the other one. A copy meets the points of two bins, which are as long as it is (width
    times a power of two), so what a task holds is a few times what one copy encloses, and pairs of a copy and a point leave no task."""
    both = copies(points)
    other = both.select("rep", (1 - c("copy")).alias("copy"), c("contig").alias("to"), c("lo").alias("to_lo"), c("hi").alias("to_hi"))
    level = F.greatest(F.lit(0), F.ceil(F.log2((c("hi") - c("lo") + 1) / width)).cast("int"))
    span = F.expr(f"shiftleft({int(width)}L, level)")
    group = ["contig", "level", "bin"]
    both = both.join(other, ["rep", "copy"]).withColumn("level", level).withColumn("bin", F.floor(c("lo") / span))
    both = materialised(both.withColumn("name", F.xxhash64("rep", "copy")).drop("rep", "copy"))
    met = both.groupBy(*group).agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"))
    members = points.where("contig is not null and loc is not null").groupBy("rep", "cluster").agg(F.collect_list(F.struct("contig", "loc")).alias("members"))
    placed = points.where("contig is not null and loc is not null").join(members, ["rep", "cluster"], "left").join(both.select("contig", "level").distinct(), "contig")
    placed = placed.withColumn("bin", F.explode(F.array(*(F.floor(c("loc") / span) - k for k in (0, 1)))))
    placed = placed.join(met, group).withColumn("part", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
    dealt = both.join(met, group).withColumn("part", F.pmod("name", "parts").cast("int"))
    left = dealt.select(*group, "part", "lo", "hi", "turned", "to", "to_lo", "to_hi").groupBy(*group, "part")
    right = placed.select(*(c(k).alias(k) for k in group), "part", "rep", "cluster", "endpt", "loc", "members").groupBy(*group, "part")
    return left.cogroup(right).applyInArrow(_projected(apart), "rep long, endpt int, cluster long, contig string, loc int")


def with_hidden(points: DataFrame, apart: int = HIDDEN_APART, width: int = 10_000) -> DataFrame:
    """points (as natural() gives them) and those that a copy has and the other copy lacks, projected on to the other one (mirrored if reversed). Projected points nearer
    than apart to the one before them or to the copy's end are dropped; of points at one place the first stays."""
    shown = projected(points, apart, width)
    new = shown.select(F.lit(None).cast("long").alias("key"), "rep", "endpt", "cluster", "contig", "loc")
    one = Window.partitionBy("contig", "loc").orderBy(c("key").isNull().desc(), "rep", "endpt", "cluster", "key")
    every = materialised(points.unionByName(new.distinct()).withColumn("n", F.row_number().over(one)).where("n = 1").drop("n"))
    # new keys follow the largest given one: per contig counts first, so no window holds all rows
    fresh = every.where("key is null")
    per = fresh.groupBy("contig").agg(F.count("*").alias("k"))
    per = per.withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = points.agg((F.max("key") + 1).alias("top"))
    number = F.row_number().over(Window.partitionBy("contig").orderBy("loc")) - 1
    fresh = fresh.join(per, "contig").crossJoin(F.broadcast(top)).withColumn("key", c("top") + c("base") + number).select(*points.columns)  # one row
    return every.where("key is not null").unionByName(fresh)


def clustered(points: DataFrame, apart: int = CLUSTER_APART) -> DataFrame:
    """Clusters of neighbours on a contig that are nearer than apart and of equal parity are one (its id: the smallest); then neighbours of one cluster
    nearer than apart are one point, the first."""
    w = Window.partitionBy("contig").orderBy("loc", "key")
    near = points.withColumn("_c", F.lag("cluster").over(w)).withColumn("_l", F.lag("loc").over(w)).withColumn("_e", F.lag("endpt").over(w))
    pairs = near.where((c("loc") - c("_l") < apart) & (F.pmod("endpt", F.lit(2)) == F.pmod("_e", F.lit(2)))).select(c("cluster").alias("src"), c("_c").alias("dst"))
    label = components(pairs).withColumnRenamed("id", "cluster")
    out = points.join(label, "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component").select(*points.columns)
    prev = out.withColumn("_c", F.lag("cluster").over(w)).withColumn("_l", F.lag("loc").over(w))
    return prev.where((c("_c").isNull()) | (c("_c") != c("cluster")) | (c("loc") - c("_l") >= apart)).drop("_c", "_l")


def sequences(points: DataFrame) -> DataFrame:
    """(contig, keys in order of place)."""
    return points.groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "key"))), lambda x: x["key"]).alias("keys"))


def neighbours(points: DataFrame) -> DataFrame:
    """Each pair of neighbouring points of a contig in both directions, with the clusters before and behind. Ends of contigs are
    clusters of their own (strings, so they equal nothing else)."""
    w = Window.partitionBy("contig").orderBy("loc", "key")
    name = lambda x: x.cast("string")
    head, tail = F.concat(F.lit("<"), c("contig")), F.concat(F.lit(">"), c("contig"))
    rows = points.withColumn("p2", F.coalesce(name(F.lag("cluster", 2).over(w)), F.when(F.lag("key").over(w).isNotNull(), head))).withColumn("p1", F.coalesce(name(F.lag("cluster").over(w)), head))
    rows = rows.withColumn("k1", F.lag("key").over(w)).withColumn("e1", F.lag("endpt").over(w)).withColumn("n1", F.coalesce(name(F.lead("cluster").over(w)), tail)).withColumn("c0", name(c("cluster")))
    first = rows.where("k1 is null").select(F.lit(None).cast("long").alias("ki"), c("key").alias("ko"), c("p1").alias("ci"), c("c0").alias("co"), F.lit(None).cast("string").alias("prev"), c("n1").alias("next"), F.lit(1).alias("ei"), c("endpt").alias("eo"))
    inner = rows.where("k1 is not null").select(c("k1").alias("ki"), c("key").alias("ko"), c("p1").alias("ci"), c("c0").alias("co"), c("p2").alias("prev"), c("n1").alias("next"), c("e1").alias("ei"), c("endpt").alias("eo"))
    last = rows.where(c("n1") == tail).select(c("key").alias("ki"), F.lit(None).cast("long").alias("ko"), c("c0").alias("ci"), c("n1").alias("co"), c("p1").alias("prev"), F.lit(None).cast("string").alias("next"), c("endpt").alias("ei"), F.lit(0).alias("eo"))
    return first.union(inner).union(last)


def non_repeat(pairs: DataFrame) -> DataFrame:
    """Cluster pairs (a, b, both orders) that somewhere lie between the end of one repeat and the begin of the next, and nowhere within one."""
    close = lambda x: c(x).isin(1, 3)
    opens = lambda x: c(x).isin(0, 2)
    out = close("ei") & opens("eo")
    known = (close("ei") | opens("ei")) & (close("eo") | opens("eo"))
    rows = pairs.groupBy(c("ci").alias("a"), c("co").alias("b")).agg(F.bool_or(out).alias("o"), F.bool_or(known & ~out).alias("i")).where("o and not i").select("a", "b")
    return rows.union(rows.select("b", "a")).distinct()


def choices(points: DataFrame) -> DataFrame:
    """Candidate cuts (choice_id, option 0 or 1, keys): pairs of clusters that are neighbours somewhere, and on either side of which
    several clusters follow or a stretch outside of repeats, with several on one side at least. One has to cut all keys of an option."""
    pairs = materialised(neighbours(points))
    free = materialised(non_repeat(pairs))
    inner = pairs.where("ki is not null and ko is not null")
    rev = inner.select(c("ko").alias("ki"), c("ki").alias("ko"), c("co").alias("ci"), c("ci").alias("co"), c("next").alias("prev"), c("prev").alias("next"))
    both = inner.select("ki", "ko", "ci", "co", "prev", "next").union(rev)
    # a pair is taken in the order in which its smaller cluster comes first
    both = both.where(F.expr("try_cast(ci as bigint) <= try_cast(co as bigint)"))
    both = both.join(free, (c("ci") == c("a")) & (c("co") == c("b")), "left_anti")
    both = both.join(free.select(c("a").alias("pa"), c("b").alias("pb"), F.lit(1).alias("fin")), (c("prev") == c("pa")) & (c("ci") == c("pb")), "left")
    both = both.join(free.select(c("a").alias("na"), c("b").alias("nb"), F.lit(1).alias("fout")), (c("co") == c("na")) & (c("next") == c("nb")), "left")
    got = both.groupBy("ci", "co").agg(
        F.array_sort(F.collect_set("ki")).alias("ins"), F.array_sort(F.collect_set("ko")).alias("outs"), F.count_distinct("prev").alias("np"), F.count_distinct("next").alias("nn"),
        F.coalesce(F.max("fin"), F.lit(0)).alias("fin"), F.coalesce(F.max("fout"), F.lit(0)).alias("fout"),
    )
    ok = got.where("(np > 1 or fin = 1) and (nn > 1 or fout = 1) and (np > 1 or nn > 1)").withColumn("choice_id", F.xxhash64("ci", "co"))
    return ok.select("choice_id", F.posexplode(F.array("ins", "outs")).alias("option", "keys"))


def _pick(pdf: pd.DataFrame) -> pd.DataFrame:
    options = [list(g.sort_values("option")["keys"]) for _, g in sorted(pdf.groupby("choice_id"), key=lambda x: min(min(k) for k in x[1]["keys"]))]
    if len(options) > EXACT_CHOICES:
        keys = set().union(*(set(o[0]) for o in options))
    else:
        sets = [set().union(*map(set, pick)) for pick in product(*options)]
        least = min(map(len, sets))
        keys = [s for s in sets if len(s) == least][-1]
    return pd.DataFrame({"key": sorted(int(k) for k in keys)})


def cuts(options: DataFrame) -> DataFrame:
    """Keys to cut: choices that share keys are decided together; the fewest keys over all combinations of up to EXACT_CHOICES choices (of equals the
    last), else each choice's first option."""
    each = options.withColumn("key", F.explode("keys"))
    hook = each.groupBy("key").agg(F.min("choice_id").alias("dst"))
    linked = components(each.join(hook, "key").select(c("choice_id").alias("src"), "dst").distinct()).withColumnRenamed("id", "choice_id")
    rows = options.join(linked, "choice_id").select("component", "choice_id", "option", "keys")
    return rows.groupBy("component").applyInPandas(lambda pdf: _pick(pdf), "key long").distinct()


def marks(keys: DataFrame, points: DataFrame, width: int = MARK) -> DataFrame:
    """Break intervals (contig, start, end) of keys."""
    return points.join(keys.distinct(), "key").select("contig", c("loc").alias("start"), (c("loc") + width).alias("end"))


def break_intervals(aln: DataFrame) -> DataFrame:
    """From repeat alignments (with rep) to break intervals."""
    points = materialised(clustered(materialised(with_hidden(natural(aln)))))
    return marks(cuts(materialised(choices(points))), points)


def _test(alpha: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_idx")
        p = group_count_test(pdf["total"].tolist(), pdf["len"].tolist(), alpha)
        return pdf.assign(p=[*p, 0])[["contig", "seg_idx", "p"]]

    return run


def count_test(segments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p (1: a boundary behind the segment) of each segment (contig, seg_idx, total, len)."""
    return segments.groupBy("contig").applyInPandas(_test(alpha), "contig string, seg_idx int, p int")


def cut_list(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """(contig, at): 0, the ends of segments (contig, seg_idx, end) with a boundary behind them, and the contig's length (the largest end)."""
    both = segments.join(decisions, ["contig", "seg_idx"])
    inner = both.where("p = 1").select("contig", c("end").alias("at"))
    edge = segments.groupBy("contig").agg(F.max("end").alias("at"))
    return inner.union(edge).union(edge.select("contig", F.lit(0))).distinct()


def split_mapping_breaks(aln: DataFrame, near: int = 30, least: int = 1000, apart: int = 50_000) -> DataFrame:
    """Breaks from reads without a full-length hit whose best prefix and best suffix are long and far apart: (read, contig_l, left, contig_r, right)."""
    low, high = F.least("s2", "e2"), F.greatest("s2", "e2")
    whole = aln.where((low <= near) & (high >= c("lq") - near)).select("qry").distinct()
    rest = aln.join(whole, "qry", "left_anti")
    t = F.struct("len2", "ref", "s1", "e1")
    best = rest.groupBy("qry").agg(F.max(F.when((low <= near) & (c("len2") > least), t)).alias("a"), F.max(F.when((high >= c("lq") - near) & (c("len2") > least), t)).alias("b"))
    far = (c("a.ref") != c("b.ref")) | (F.abs(c("a.e1") - c("b.s1")) > apart)
    return best.where("a is not null and b is not null").where(far).select(c("qry").alias("read"), c("a.ref").alias("contig_l"), c("a.e1").alias("left"), c("b.ref").alias("contig_r"), c("b.s1").alias("right"))
