"""Cutting misassembled contigs with long reads: adaptor fix, redundancy, repeats, break model, test of counts, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import embedded, repeat_match
from ..operators import aggregates as A
from ..operators import breaks as B
from ..operators import intervals as I
from ..operators import joins as J
from ..operators.resolve import without_redundant
from ..schemas import ADAPTOR, AGGRESSIVE_END, AGGRESSIVE_GAP, AGGRESSIVE_MATCH, REPEAT_APART, REPEAT_END, REPEAT_MATCH, SEGMENT_LEAST, SEGMENT_SPAN, SEGMENT_TRIM, RepairOptions
from .runtime import materialised

c = F.col


def adaptor_breaks(aln: DataFrame, zone: int = ADAPTOR["end_zone"], gap: int = ADAPTOR["gap"], least: int = ADAPTOR["match"]) -> DataFrame:
    """(name, from, to): the piece to cut out of contigs with a palindromic match to themselves: a copy at one end of the contig, followed within gap by its reverse.
    The first match of a contig decides (by s1, e1). Without such an end the piece is empty, between the two copies."""
    low, high = F.least("s2", "e2"), F.greatest("s2", "e2")
    own = aln.where((c("ref") == c("qry")) & (c("s2") > c("e2")) & (c("len1") >= least))
    rows = own.withColumn("a1", F.least("s1", low)).withColumn("b1", F.when(c("s1") <= low, c("e1")).otherwise(high)).withColumn("a2", F.greatest("s1", low)).withColumn("b2", F.when(c("s1") <= low, high).otherwise(c("e1")))
    rows = rows.where(c("a2") - c("b1") <= gap)
    middle = F.floor((F.least("b1", "a2") + F.greatest("b1", "a2")) / 2).cast("int")
    cut_from = F.when(c("a1") <= zone, 0).otherwise(middle)
    cut_to = F.when(c("a1") <= zone, middle).when(c("b2") >= c("lr") - zone, c("lr")).otherwise(middle)
    first = F.row_number().over(Window.partitionBy("ref").orderBy("s1", "e1", "s2"))
    return rows.select(c("ref").alias("name"), cut_from.alias("from"), cut_to.alias("to"), first.alias("n")).where("n = 1").drop("n")


def without_adaptors(contigs: DataFrame, found: DataFrame) -> DataFrame:
    """Contigs cut at found breaks, without the piece between them."""
    cuts = found.select("name", F.explode(F.array("from", "to")).alias("at"))
    pieces = I.cut(contigs.select("name", "seq").join(found.select("name"), "name", "left_semi"), cuts)
    w = Window.partitionBy("name").orderBy("piece")
    place = pieces.withColumn("end", F.sum(F.length("seq")).over(w)).withColumn("begin", c("end") - F.length("seq"))
    kept = place.join(found, "name").where(~((c("begin") >= c("from")) & (c("end") <= c("to")) & (c("to") > c("from"))))
    rest = contigs.select("name", "seq").join(found.select("name"), "name", "left_anti")
    return rest.union(kept.select(F.concat("name", F.lit("_"), "piece").alias("name"), "seq"))


def coverage(aln: DataFrame) -> DataFrame:
    """(contig, start, end, depth) of one embedded placement per read."""
    placed = A.placement(aln, embedded())
    return A.depth_segments(placed.select(c("ref").alias("contig"), (c("s1") - 1).alias("s"), c("e1").alias("e")), "contig", "s", "e")


def segments(marks: DataFrame, depth: DataFrame, lengths: DataFrame, trim: int = SEGMENT_TRIM, span: int = SEGMENT_SPAN, width: int = 10_000) -> DataFrame:
    """(contig, seg_idx, total, len, end) between marks: depth summed from `trim` behind the begin, over `span` bases at most."""
    points = marks.select("contig", c("start").alias("at")).union(lengths.select(c("name").alias("contig"), c("len").alias("at")).join(marks.select("contig").distinct(), "contig", "left_semi")).distinct()
    w = Window.partitionBy("contig").orderBy("at")
    rows = points.withColumn("begin", F.coalesce(F.lag("at").over(w), F.lit(0))).withColumn("seg_idx", (F.row_number().over(w) - 1).cast("int")).where(c("at") - c("begin") >= SEGMENT_LEAST)
    rows = rows.withColumn("rs", F.least(c("begin") + trim, c("at") - 1)).withColumn("re", F.least(c("at"), c("rs") + span))
    sums = A.depth_in_ranges(depth, rows.select("contig", "rs", "re"), "contig", width)
    return rows.join(sums, ["contig", "rs", "re"]).select("contig", "seg_idx", c("total").cast("double").alias("total"), (c("re") - c("rs")).cast("int").alias("len"), c("at").alias("end"))


def fix(contigs: DataFrame, reads: DataFrame, options: RepairOptions = RepairOptions(), scale: float = 1.0, k: int = 20) -> DataFrame:  # noqa: B008
    """Contigs (name, seq), cut where repeats between contigs and a change of coverage say so. scale shrinks the lengths that repeats
    and adaptors must have, for small genomes."""
    n = lambda x: max(1, int(x * scale))
    lengths = lambda df: df.select("name", F.length("seq").alias("len"))
    if options.toRunAdaptor:
        own = J.with_lengths(J.align(contigs, contigs, k, least=n(ADAPTOR["match"])), lengths(contigs))
        contigs = materialised(without_adaptors(contigs, materialised(adaptor_breaks(own, n(ADAPTOR["end_zone"]), n(ADAPTOR["gap"]), n(ADAPTOR["match"])))))
    own = materialised(J.with_lengths(J.align(contigs, contigs, k), lengths(contigs)))
    contigs = materialised(without_redundant(contigs, own))
    own = own.join(contigs.select(c("name").alias("ref")), "ref", "left_semi").join(contigs.select(c("name").alias("qry")), "qry", "left_semi")
    if options.toRunAggressive:
        repeats = own.where(repeat_match(n(AGGRESSIVE_MATCH), n(AGGRESSIVE_END), n(REPEAT_APART)))
        cuts = I.separated(repeats.select(c("ref").alias("name"), "s1", "e1"), "name", "s1", "e1", n(AGGRESSIVE_GAP))
    else:
        # each repeat once: rows of one pair come in both directions
        found = own.where(repeat_match(n(REPEAT_MATCH), REPEAT_END, n(REPEAT_APART))).where((c("ref") < c("qry")) | ((c("ref") == c("qry")) & (c("s1") < F.least("s2", "e2"))))
        base = found.groupBy("ref").agg(F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy("ref").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found = found.join(base, "ref").withColumn("rep", (c("base") + F.row_number().over(Window.partitionBy("ref").orderBy("qry", "s1", "e1", "s2"))).cast("long"))
        marks = materialised(B.break_intervals(found.select("s1", "e1", "s2", "e2", "ref", "qry", "rep")))
        mapped = J.with_lengths(J.align(contigs, reads, k), lengths(contigs).union(lengths(reads)))
        segs = materialised(segments(marks, materialised(coverage(mapped)), lengths(contigs)))
        cuts = B.cut_list(segs, B.count_test(segs)).select(c("contig").alias("name"), "at")
    pieces = materialised(I.cut(contigs.select("name", "seq"), cuts).select(F.concat("name", F.lit("_"), "piece").alias("name"), "seq"))
    again = J.with_lengths(J.align(pieces, pieces, k), lengths(pieces))
    return without_redundant(pieces, again)


def coverage_breaks(depth: DataFrame, lengths: DataFrame, t: int = 1000, multiple: float = 5, confirm: float = 5, step: int | None = None) -> DataFrame:
    """(contig, at): where the mean depth of the t bases behind differs most from that of the t bases before, by `multiple` standard deviations (those of
    the middle half of differences), and the mean depths up to the next breaks differ too. Means are taken every t / 10 bases from depth
    segments, never per base. Contigs of 12 t or less have none; peaks suppress others within 6 t."""
    step = step or max(1, t // 10)
    long = lengths.where(c("len") > 12 * t).select(c("name").alias("contig"), "len")
    points = long.select("contig", F.explode(F.sequence(F.lit(t), (c("len") - t).cast("int"), F.lit(step))).alias("at"))
    back = points.select("contig", (c("at") - t).alias("rs"), c("at").alias("re"))
    ahead = points.select("contig", c("at").alias("rs"), (c("at") + t).alias("re"))
    sums = materialised(A.depth_in_ranges(depth, back.union(ahead).distinct(), "contig", 10 * t))
    b = sums.select("contig", c("re").alias("at"), (c("total") / t).alias("b"))
    a = sums.select("contig", c("rs").alias("at"), (c("total") / t).alias("a"))
    diff = materialised(points.join(b, ["contig", "at"]).join(a, ["contig", "at"]).select("contig", "at", (c("a") - c("b")).alias("diff")))
    sd = A.interquartile_std(diff, "diff").first()["sd"] or 0.0
    found = materialised(I.peaks(diff, "contig", "at", "diff", multiple * sd, 6 * t))
    return I.confirmed(found, depth, "contig", "at", confirm * sd, t // 4, 10 * t)


def cut_extended(contigs: DataFrame, breaks: DataFrame) -> DataFrame:
    """(name, piece, seq): contigs cut at two-sided breaks (name, left, right, left_more, right_more): the piece before ends at left and goes on with left_more, what a
    read adds; the piece behind begins with right_more at right. A null side ends or begins where the other side is."""
    b = breaks.withColumns({"left": F.coalesce("left", "right"), "right": F.coalesce("right", "left")})
    rows = b.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("left", "right", F.coalesce("left_more", F.lit("")).alias("lm"), F.coalesce("right_more", F.lit("")).alias("rm")))).alias("b"))
    x = contigs.select("name", "seq").join(rows, "name", "left").withColumn("b", F.coalesce("b", F.array().cast("array<struct<left: int, right: int, lm: string, rm: string>>")))
    n = F.size("b")
    piece = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.concat(
            F.when(i > 0, F.get("b", i - 1)["rm"]).otherwise(""),
            F.substr(c("seq"), F.when(i > 0, F.get("b", i - 1)["right"]).otherwise(0) + 1, F.greatest(F.lit(0), F.when(i < n, F.get("b", i)["left"]).otherwise(F.length("seq")) - F.when(i > 0, F.get("b", i - 1)["right"]).otherwise(0))),
            F.when(i < n, F.get("b", i)["lm"]).otherwise(""),
        ),
    )
    return x.select("name", F.posexplode(piece).alias("piece", "seq"))


def with_overhangs(contigs: DataFrame, breaks: DataFrame, reads: DataFrame) -> DataFrame:
    """breaks (name, left, right, left_read, right_read) with left_more and right_more for cut_extended: what the read on the left goes on with behind the end of the
    piece before (its overlap with that piece's end left out), and what the read on the right has before the piece behind. Without an overlap or a read: null."""
    read = lambda k, out: reads.select(c("name").alias(k), c("seq").alias(out))
    rows = breaks.join(contigs.select("name", "seq"), "name").join(read("left_read", "lr"), "left_read", "left").join(read("right_read", "rr"), "right_read", "left")
    rows = rows.withColumn("o", J.overlaps(F.substr(c("seq"), F.lit(1), F.coalesce("left", F.lit(0))), F.coalesce("lr", F.lit(""))))
    rows = rows.withColumn("p", J.overlaps(F.coalesce("rr", F.lit("")), F.when(c("right").isNull(), "").otherwise(F.substr(c("seq"), c("right") + 1))))
    more = F.when(c("o.right") > 0, F.substr(c("lr"), c("o.right") + 1))
    before = F.when(c("p.left") > 0, F.substr(c("rr"), F.lit(1), F.length("rr") - c("p.left")))
    return rows.select("name", "left", "right", more.alias("left_more"), before.alias("right_more"))


def fix_with_short(long_contigs: DataFrame, short_contigs: DataFrame, short_reads: DataFrame, long_reads: DataFrame, options: RepairOptions = RepairOptions(), t: int = 1000, k: int = 20) -> DataFrame:  # noqa: B008
    """Two sets of contigs, each checked with the other kind of reads, and merged: long contigs are cut where the coverage by short reads changes, short ones where long
    reads map in two far parts; short contigs that a long one covers go."""
    lengths = lambda df: df.select("name", F.length("seq").alias("len"))
    mapped = J.with_lengths(J.align(long_contigs, short_reads, k), lengths(long_contigs).union(lengths(short_reads)))
    placed = A.placement(mapped, embedded("SR") | embedded())
    depth = materialised(A.depth_segments(placed.select(c("ref").alias("contig"), (c("s1") - 1).alias("s"), c("e1").alias("e")), "contig", "s", "e"))
    at = coverage_breaks(depth, lengths(long_contigs), t, 13)
    lc = materialised(I.cut(long_contigs.select("name", "seq"), at.select(c("contig").alias("name"), "at")).select(F.concat("name", F.lit("_"), "piece").alias("name"), "seq"))
    split = J.with_lengths(J.align(short_contigs, long_reads, k), lengths(short_contigs).union(lengths(long_reads)))
    found = B.split_mapping_breaks(split, 30, t, 50 * t)
    ends = found.select(c("contig_l").alias("name"), c("left").alias("at")).union(found.select("contig_r", "right")).groupBy("name", "at").agg(F.count("*").alias("n"))
    near = I.spaced(F.collect_set("at"), t)
    sc_at = ends.groupBy("name").agg(near.alias("a")).select("name", F.explode("a").cast("int").alias("at"))
    sc = materialised(I.cut(short_contigs.select("name", "seq"), sc_at).select(F.concat("name", F.lit("_"), "piece").alias("name"), "seq"))
    from ..operators.resolve import without_covered

    covered = J.with_lengths(J.align(lc, sc, k), lengths(lc).union(lengths(sc)))
    return lc.union(without_covered(sc, covered).select("name", "seq"))
