"""Phasing of repeats by single-base differences, and copy numbers of tandem repeats, from reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import global_alignment
from ..functions.sequence import beside_run
from ..operators import graph as G
from ..operators import joins as J
from ..operators import phasing as P
from ..operators import resolve as R
from ..operators.aggregates import votes
from .runtime import materialised

c = F.col


def repeats_of(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rep_id, ins, outs): repeats between long contigs, one strand of each. lengths (idx, len)."""
    found = G.bipartite_repeats(R.long_contig_edges(edges, lengths)).where("size(ins) > 0 and size(outs) > 0")
    return R.one_strand(found)


def variants(reads: DataFrame, low: float = 0.2, least: int = 4, run: int = 5) -> DataFrame:
    """(rep_id, v1, v2): the two variants of the stretch that reads (rep_id, read, seq) of a repeat cover from end to end. The longest read is the
    template; places where two letters are frequent differ, but for those beside a run of so many equal letters; letters that occur with the first (second) letter of the first such place make v1 (v2)."""
    w = Window.partitionBy("rep_id").orderBy(F.length("seq").desc(), "read")
    temp = reads.withColumn("n", F.row_number().over(w)).where("n = 1").select("rep_id", c("seq").alias("template"))
    both = reads.join(temp, "rep_id").withColumn("a", global_alignment("template", "seq"))
    each = materialised(votes(both.select(F.struct("rep_id", "read").alias("k"), c("a.a").alias("a1"), c("a.b").alias("a2")), "k").select("k.rep_id", "k.read", "pos", "kind", "offset", "base", "n"))
    places = materialised(P.differing_places(each.groupBy("rep_id", "pos", "kind", "offset", "base").agg(F.sum("n").alias("n")), "rep_id", low, least))
    places = places.join(temp, "rep_id").where(~beside_run("template", "pos", run)).drop("template")
    first = places.groupBy("rep_id").agg(F.min(F.struct("pos", "first", "second")).alias("f"))
    seen = each.where("kind in ('same', 'sub')").join(places.select("rep_id", "pos"), ["rep_id", "pos"]).select("rep_id", "read", "pos", "base")
    side = seen.join(first, "rep_id").where("pos = f.pos").select("rep_id", "read", F.when(c("base") == c("f.first"), 1).when(c("base") == c("f.second"), 2).alias("v")).where("v is not null")
    count = seen.join(side, ["rep_id", "read"]).groupBy("rep_id", "v", "pos", "base").agg(F.count("*").alias("n"))
    best = count.groupBy("rep_id", "v", "pos").agg(F.min(F.struct((-c("n")).alias("m"), "base")).alias("t"))
    edits = best.select(F.concat_ws("_", "rep_id", "v").alias("read"), "pos", F.lit("sub").alias("edit"), F.lit(0).alias("offset"), c("t.base").alias("base"))
    two = temp.select("rep_id", c("template").alias("seq"), F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).withColumn("read", F.concat_ws("_", "rep_id", "v"))
    fixed = P.corrected(two.select("read", "seq"), edits).join(two.select("read", "rep_id", "v"), "read")
    return fixed.groupBy("rep_id").agg(F.max(F.when(c("v") == 1, c("seq"))).alias("v1"), F.max(F.when(c("v") == 2, c("seq"))).alias("v2"))


def phase_repeats(repeats: DataFrame, reads: DataFrame) -> DataFrame:
    """(rep_id, l, r): pairs of ins and outs of repeats with two of each. reads (rep_id, read, side, seq): side l for reads of in 1, r for reads that lead to out 1, m for
    others; all cover the stretch whose variants tell the copies apart. As they cover it whole, nothing has to be linked through the middle: reads of side m
    only help to find the variants."""
    two = repeats.where("size(ins) = 2 and size(outs) = 2")
    both = reads.join(variants(reads.select("rep_id", "read", "seq")), "rep_id")
    result = P.phase(both.where("side in ('l', 'r')").select("rep_id", "side", "seq", "v1", "v2"))
    x = two.join(result, "rep_id")
    pairs = F.when(c("result") == 0, F.array(F.struct(c("ins")[0].alias("l"), c("outs")[0].alias("r")), F.struct(c("ins")[1].alias("l"), c("outs")[1].alias("r")))).otherwise(F.array(F.struct(c("ins")[0].alias("l"), c("outs")[1].alias("r")), F.struct(c("ins")[1].alias("l"), c("outs")[0].alias("r"))))
    return x.select("rep_id", F.explode(pairs).alias("p")).select("rep_id", "p.l", "p.r")


def tandem_copies(units: DataFrame, reads: DataFrame, depth: float, k: int = 20, times: int = P.REPEATED) -> DataFrame:
    """(name, copies) of repeat units (name, seq): bases of reads that match a template of `times` units, by depth and unit length."""
    temp = units.select("name", F.repeat("seq", F.lit(times)).alias("seq"))
    aln = J.align(temp, reads, k)
    best = aln.groupBy("ref", "qry").agg(F.max(F.greatest("len1", "len2")).alias("n"))
    total = best.groupBy(c("ref").alias("name")).agg(F.sum("n").alias("bases"))
    return units.select("name", F.length("seq").alias("len")).join(total, "name", "left").select("name", (F.coalesce("bases", F.lit(0)) / (c("len") * depth)).alias("copies"))
