"""Redundant contigs, string graphs of contigs and reads, resolving of repeats by abundance and by bridging reads, gap content and read-out."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement, twin
from ..plans.runtime import materialised
from ..schemas import DOVETAIL, PHASE_CONTIG, REDUNDANT
from .aggregates import conflict_free
from .contraction import contracted
from .graph import components, shortest_paths
from .joins import overlaps

c = F.col


# redundancy


def inside(aln: DataFrame, near: int = REDUNDANT) -> DataFrame:
    """(small, large): queries that a match covers from end to end. aln has lr and lq."""
    low, high = F.least("s2", "e2"), F.greatest("s2", "e2")
    return aln.where((c("ref") != c("qry")) & (low <= near) & (high >= c("lq") - near)).select(c("qry").alias("small"), c("ref").alias("large")).distinct()


def without_redundant(seqs: DataFrame, aln: DataFrame, near: int = REDUNDANT) -> DataFrame:
    """seqs (name, ...) without those inside another one; of sequences inside each other one stays, the smallest name."""
    ins = inside(aln, near)
    back = ins.select(c("large").alias("small"), c("small").alias("large"))
    mutual = ins.join(back, ["small", "large"], "left_semi")
    strict = ins.join(back, ["small", "large"], "left_anti").select(c("small").alias("name"))
    ids = mutual.select(F.xxhash64("small").alias("src"), F.xxhash64("large").alias("dst"))
    names = mutual.select(c("small").alias("name"), F.xxhash64("small").alias("id")).distinct()
    groups = names.join(components(ids), "id")
    first = groups.groupBy("component").agg(F.min("name").alias("kept"))
    twins = groups.join(first, "component").where("name <> kept").select("name")
    return seqs.join(strict.union(twins).distinct(), "name", "left_anti")


def without_covered(queries: DataFrame, aln: DataFrame, near: int = REDUNDANT) -> DataFrame:
    """Queries that no target covers from end to end."""
    return queries.join(inside(aln, near).select(c("small").alias("name")).distinct(), "name", "left_anti")


# string graph


def overlap_edges(aln: DataFrame, ref_id: Column, qry_id: Column, end: int = DOVETAIL) -> DataFrame:
    """Edges (src, dst, wt) of dovetails, for both strands. ref_id and qry_id are the forward nodes; a reversed match is one of the
    query's other strand. aln has lr and lq."""
    turned = c("s2") > c("e2")
    s, e = F.when(turned, c("lq") - c("s2") + 1).otherwise(c("s2")), F.when(turned, c("lq") - c("e2") + 1).otherwise(c("e2"))
    rows = aln.select(ref_id.cast("long").alias("r"), F.when(turned, twin(qry_id.cast("long"))).otherwise(qry_id.cast("long")).alias("q"), "s1", "e1", s.alias("s"), e.alias("e"), "lr", "lq", F.least("len1", "len2").alias("wt"))
    out = rows.where((c("e1") >= c("lr") - end) & (c("s") <= end) & (c("r") != c("q"))).select(c("r").alias("src"), c("q").alias("dst"), "wt")
    into = rows.where((c("s1") <= end) & (c("e") >= c("lq") - end) & (c("r") != c("q"))).select(c("q").alias("src"), c("r").alias("dst"), "wt")
    every = out.union(into)
    every = every.union(every.select(twin("dst"), twin("src"), "wt"))
    return every.groupBy("src", "dst").agg(F.max("wt").cast("int").alias("wt"))


def string_graph(contig_contig: DataFrame, contig_read: DataFrame, contigs: int, read_read: DataFrame | None = None, end: int = DOVETAIL) -> DataFrame:
    """Edges between contigs (ids below `contigs`) and reads from alignments with ref_idx and qry_idx."""
    at = lambda k, base: c(k) * 2 + base
    parts = [overlap_edges(contig_contig, at("ref_idx", 0), at("qry_idx", 0), end), overlap_edges(contig_read, at("ref_idx", 0), at("qry_idx", contigs), end)]
    if read_read is not None:
        parts.append(overlap_edges(read_read, at("ref_idx", contigs), at("qry_idx", contigs), end))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("src", "dst").agg(F.max("wt").alias("wt"))


# resolving


def abundance_match(repeats: DataFrame, depth: DataFrame, sd: float | Column, lower: float, upper: float) -> DataFrame:
    """(rep_id, l, r): an in and an out of a repeat, of different contigs, whose depths differ by lower * sd at most, where no other out is within
    upper * sd of the in and no other in within upper * sd of the out."""
    ins = repeats.select("rep_id", F.explode("ins").alias("l")).join(depth.select(c("id").alias("l"), c("depth").alias("a")), "l")
    outs = repeats.select("rep_id", F.explode("outs").alias("r")).join(depth.select(c("id").alias("r"), c("depth").alias("b")), "r")
    sd = F.lit(sd) if isinstance(sd, float | int) else sd
    pairs = ins.join(outs, "rep_id").where(F.floor(c("l") / 2) != F.floor(c("r") / 2)).withColumn("d", F.abs(c("a") - c("b")))
    near = F.count_if(c("d") <= sd * upper)
    pairs = pairs.withColumn("nl", near.over(Window.partitionBy("rep_id", "l"))).withColumn("nr", near.over(Window.partitionBy("rep_id", "r")))
    good = pairs.where((c("d") <= sd * lower) & (c("nl") == 1) & (c("nr") == 1))
    return good.select("rep_id", "l", "r")


def sole_contig(edges: DataFrame, contigs: int) -> DataFrame:
    """(read, contig): reads from which ways through reads lead to one contig only, however long. Each read passes on the least and the largest
    contig that it knows of, until nothing changes; reads that lead to the same are contracted before. Without edges between reads none is passed on."""
    if not edges.where((c("src") >= contigs) & (c("dst") >= contigs)).limit(1).count():
        last = edges.where((c("src") >= contigs) & (c("dst") < contigs)).groupBy(c("src").cast("long").alias("read"))
        return last.agg(F.min(c("dst").cast("long")).alias("contig"), F.max("dst").alias("hi")).where("contig = hi").drop("hi")
    place, step = contracted(edges, contigs)
    now = materialised(step.where((c("src") >= contigs) & (c("dst") < contigs)).groupBy(c("src").alias("id")).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi")))
    links = materialised(step.where((c("src") >= contigs) & (c("dst") >= contigs)))
    state = None
    while True:
        told = links.join(now.withColumnRenamed("id", "dst").hint("merge"), "dst").select(c("src").alias("id"), "lo", "hi")
        now = materialised(now.union(told).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        new = now.agg(F.count("*"), F.sum((c("hi") - c("lo")).cast("decimal(38,0)"))).first()  # both only grow
        if new == state:
            break
        state = new
    return place.join(now.where("lo = hi").select(c("id").alias("at"), c("lo").alias("contig")).hint("merge"), "at").select(c("id").alias("read"), "contig")


def bridge_match(repeats: DataFrame, edges: DataFrame, contigs: int, least: int = 2, both_ways: bool = False) -> DataFrame:
    """(rep_id, l, r, n): an in and an out of a repeat that so many reads join, each reached from just one of the ins and leading to one of the outs.
    both_ways: only reads that no other contig is reached from, onwards and backwards, through any number of reads."""
    ins, outs = repeats.select("rep_id", F.explode("ins").alias("l")), repeats.select("rep_id", F.explode("outs").alias("r"))
    e = edges.select("src", "dst").distinct()
    a = ins.join(e, c("l") == c("src")).where(c("dst") >= contigs).select("rep_id", "l", c("dst").alias("read"))
    b = outs.join(e, c("r") == c("dst")).where(c("src") >= contigs).select("rep_id", "r", c("src").alias("read"))
    one = lambda df, k: df.groupBy("rep_id", "read").agg(F.min(k).alias(k), F.count("*").alias("n")).where("n = 1").drop("n")
    pairs = one(a, "l").join(one(b, "r"), ["rep_id", "read"]).where(F.floor(c("l") / 2) != F.floor(c("r") / 2))
    if both_ways:
        pairs = pairs.join(sole_contig(e, contigs).select("read"), "read", "left_semi")
        pairs = pairs.join(sole_contig(e.select(c("dst").alias("src"), c("src").alias("dst")), contigs).select("read"), "read", "left_semi")
    return pairs.groupBy("rep_id", "l", "r").agg(F.count("*").alias("n")).where(c("n") >= least)


def long_contig_edges(edges: DataFrame, lengths: DataFrame, least: int = PHASE_CONTIG) -> DataFrame:
    """Edges between contigs (node id // 2 is the idx of lengths: idx, len) of so many letters at least, without those of a contig with itself."""
    long = lengths.where(c("len") >= least).select("idx")
    near, far = long.select(c("idx").alias("_s")), long.select(c("idx").alias("_d"))
    kept = edges.where(F.floor(c("src") / 2) != F.floor(c("dst") / 2))
    return kept.join(near, F.floor(c("src") / 2) == c("_s"), "left_semi").join(far, F.floor(c("dst") / 2) == c("_d"), "left_semi")


def one_strand(repeats: DataFrame) -> DataFrame:
    """Repeats (rep_id, ins, outs) without those that are another one seen from the other strand: its outs turned are the ins, its ins turned the outs. The
    smaller spelling stays, of equal ones the smaller rep_id."""
    turned = lambda x: F.array_sort(F.transform(x, lambda i: i.bitwiseXOR(F.lit(1).cast("long"))))
    spelled = repeats.withColumn("own", F.struct(F.array_sort("ins").alias("i"), F.array_sort("outs").alias("o"))).withColumn("other", F.struct(turned("outs").alias("i"), turned("ins").alias("o")))
    best = spelled.groupBy(F.least("own", "other").alias("key")).agg(F.min(F.struct((c("own") > c("other")).alias("back"), "rep_id", "ins", "outs")).alias("m"))
    return best.select("m.rep_id", "m.ins", "m.outs")


def separate_paths(paths: DataFrame) -> DataFrame:
    """(rep_id, l1, r1, l2, r2): of the paths (rep_id, l, r) of a repeat the first two, in order of l and r, that differ at both ends. The first begins at the
    least l of all, or there are none: if all others end where a path from there does, they do so from there too, or it has another end. So no path meets
    another, only the least of its repeat."""
    row = lambda cond: F.min(F.when(cond, F.struct("l", "r")))
    first = paths.groupBy("rep_id").agg(F.min(F.struct("l", "r")).alias("a"))
    behind, other = c("l") > c("a.l"), c("r") != c("a.r")
    found = paths.join(first, "rep_id").groupBy("rep_id").agg(F.first("a").alias("a"), row(behind & other).alias("far"), row(behind).alias("next"), F.min(F.when(~behind & other, c("r"))).alias("second"))
    plain = c("far").isNotNull()
    out = found.where(plain | (c("next").isNotNull() & c("second").isNotNull()))
    partner = F.when(plain, c("far")).otherwise(c("next"))
    return out.select("rep_id", c("a.l").alias("l1"), F.when(plain, c("a.r")).otherwise(c("second")).alias("r1"), partner["l"].alias("l2"), partner["r"].alias("r2"))


def resolved_pairs(*found: DataFrame) -> DataFrame:
    """(l, r) of all methods without those in conflict, and their mirrors."""
    every = found[0].select("l", "r")
    for f in found[1:]:
        every = every.union(f.select("l", "r"))
    every = every.union(every.select(twin("r"), twin("l"))).distinct()
    return conflict_free(every)


def x_nodes(edges: DataFrame, depth: DataFrame, sd: float, lower: float, upper: float) -> DataFrame:
    """(node, src, dst): ways through nodes with several edges in and out that depth alone pairs up."""
    ins = edges.groupBy(c("dst").alias("node")).agg(F.collect_set("src").alias("ins"))
    outs = edges.groupBy(c("src").alias("node")).agg(F.collect_set("dst").alias("outs"))
    rep = ins.join(outs, "node").where("size(ins) > 1 and size(outs) > 1").select(c("node").alias("rep_id"), "ins", "outs")
    return abundance_match(rep, depth, sd, lower, upper).select(c("rep_id").alias("node"), c("l").alias("src"), c("r").alias("dst"))


# reads around contigs


def expand_reads(aln: DataFrame, seeds: DataFrame, rounds: int, among: Column | None = None) -> DataFrame:
    """(qry): the reads (qry) of seeds and those that so many rounds add, each with all reads aligned to a contig (ref) that the reads so far are
    aligned to; it ends early when a round adds none. among: only contigs that fulfil it are expanded."""
    pairs = aln.select("ref", "qry").distinct()
    now = materialised(seeds.select("qry").distinct())
    n = now.count()
    for _ in range(rounds):
        refs = pairs.join(now, "qry", "left_semi").select("ref").distinct()
        refs = refs if among is None else refs.where(among)
        now = materialised(pairs.join(refs, "ref", "left_semi").select("qry").union(now).distinct())
        n, before = now.count(), n
        if n == before:
            break
    return now


# sequences of paths


def paths_between(pairs: DataFrame, edges: DataFrame, contigs: int) -> DataFrame:
    """(l, r, path): for each pair the shortest way through reads, however long, by parent links of breadth-first searches from all l.
    Pairs without a way have no row and are warned of."""
    pairs = pairs.select("l", "r").distinct()
    wanted = pairs.select(c("l").alias("source"), c("r").alias("id"))
    tree = shortest_paths(edges, pairs.select(c("l").alias("id")).distinct(), through=c("id") >= contigs, wanted=wanted)
    lost = wanted.join(tree, ["source", "id"], "left_anti")
    if some := lost.limit(5).collect():
        warnings.warn(f"{lost.count()} pairs have no way through reads between them, among them {[tuple(x) for x in some]}", stacklevel=2)
    step = tree.select("source", c("id").alias("at"), c("parent").alias("q"))
    now = materialised(pairs.join(step, (c("l") == c("source")) & (c("r") == c("at"))).select("l", "r", F.array("r").alias("path"), c("q").alias("p")))
    while now.where("p <> l").limit(1).count():
        rest = now.where("p <> l").join(step, (c("l") == c("source")) & (c("p") == c("at"))).select("l", "r", F.concat(F.array("p"), c("path")).alias("path"), c("q").alias("p"))
        now = materialised(now.where("p is null or p = l").union(rest))
    return now.select("l", "r", F.concat(F.array("l"), "path").alias("path"))


def gap_contents(paths: DataFrame, seqs: DataFrame) -> DataFrame:
    """(l, r, start, middle): how many letters of r the overlap with what comes before takes, and the letters between l and r. paths (l, r, path),
    seqs (id, seq) for all oriented nodes; overlaps of neighbours are aligned in Arrow batches."""
    steps = paths.select("l", "r", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("i", "p")).select("l", "r", "i", c("p.a").alias("a"), c("p.b").alias("b"))
    joined = steps.join(seqs.select(c("id").alias("a"), c("seq").alias("sa")), "a").join(seqs.select(c("id").alias("b"), c("seq").alias("sb")), "b")
    cut = joined.withColumn("o", overlaps("sa", "sb")["right"])
    rows = cut.groupBy("l", "r").agg(F.array_sort(F.collect_list(F.struct("i", "b", "o", "sb"))).alias("s"))
    inner = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: F.substr(x["sb"], x["o"] + 1))
    return rows.select("l", "r", F.element_at("s", -1)["o"].alias("start"), F.array_join(inner, "").alias("middle"))


def read_out(nodes: DataFrame, seqs: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(node, seq): each node's members joined, one strand of each twin pair: the one whose smallest member comes first. Members that no node
    has are appended by themselves. nodes (id, members, overlaps), seqs (id, seq) for all oriented sequences. Where gaps are given and lack one, what lies
    between two members is not known: the node ends there, and its rest is one of its own (node id, _ and a number)."""
    keyed = nodes.withColumn("k", F.array_join(F.transform("members", lambda m: F.lpad(m.cast("string"), 20, "0")), ",")).withColumn("t", F.array_join(F.transform(F.reverse("members"), lambda m: F.lpad(m.bitwiseXOR(F.lit(1).cast("long")).cast("string"), 20, "0")), ","))
    one = keyed.withColumn("canon", F.least("k", "t")).withColumn("n", F.row_number().over(Window.partitionBy("canon").orderBy("k"))).where("n = 1")
    each = one.select("id", F.posexplode(F.arrays_zip("members", "overlaps")).alias("i", "m")).select("id", "i", c("m.members").alias("m"), c("m.overlaps").alias("o"))
    each = each.withColumn("before", F.lag("m").over(Window.partitionBy("id").orderBy("i")))
    if gaps is not None:
        each = each.join(gaps.select(c("l").alias("before"), c("r").alias("m"), "start", "middle"), ["before", "m"], "left")
        lost = (c("before").isNotNull() & c("start").isNull()).cast("int")
        each = each.withColumn("part", F.sum(lost).over(Window.partitionBy("id").orderBy("i")))
    else:
        each = each.withColumn("start", F.lit(None).cast("int")).withColumn("middle", F.lit(None).cast("string")).withColumn("part", F.lit(0).cast("long"))
    alone = c("start").isNull() if gaps is not None else F.lit(False)
    piece = F.concat(F.coalesce("middle", F.lit("")), F.when(alone, c("seq")).otherwise(F.substr(c("seq"), F.coalesce("start", "o") + 1)))
    joined = each.join(seqs.select(c("id").alias("m"), "seq"), "m").withColumn("piece", piece)
    out = joined.groupBy("id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    out = out.select(F.concat(c("id").cast("string"), F.when(c("part") > 0, F.concat(F.lit("_"), "part")).otherwise("")).alias("node"), "seq")
    used = nodes.select(F.explode("members").alias("m")).select(F.floor(c("m") / 2).alias("u")).distinct()
    rest = seqs.where(c("id") % 2 == 0).join(used, F.floor(c("id") / 2) == c("u"), "left_anti").select(c("id").cast("string").alias("node"), "seq")
    return out.union(rest)


def oriented(seqs: DataFrame) -> DataFrame:
    """(id, seq) of both strands of sequences with an idx."""
    return seqs.select(F.explode(F.array(F.struct((c("idx") * 2).alias("id"), c("seq")), F.struct((c("idx") * 2 + 1).alias("id"), reverse_complement("seq").alias("seq")))).alias("x")).select("x.id", "x.seq")


# gap filling with one read


def usable_ends(attached: DataFrame, open_ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attachments at ends that are open (name, no_prev, no_next), and the others."""
    both = attached.join(open_ends, attached["contig"] == open_ends["name"], "left")
    free = F.coalesce(F.when(c("side") == "L", c("no_prev")).otherwise(c("no_next")), F.lit(False))
    return both.where(free).select(*attached.columns), both.where(~free).select(*attached.columns)


def unique_partners(pairs: DataFrame) -> DataFrame:
    """Pairs (l, r, ...) whose l has no other r and whose r no other l."""
    bad_l = pairs.groupBy("l").agg(F.count_distinct("r").alias("n")).where("n > 1").select("l")
    bad_r = pairs.groupBy("r").agg(F.count_distinct("l").alias("n")).where("n > 1").select("r")
    return pairs.join(bad_l, "l", "left_anti").join(bad_r, "r", "left_anti").select(*pairs.columns)


# labels around a repeat


def reach_labels(edges: DataFrame, repeats: DataFrame, contigs: int) -> DataFrame:
    """(rep_id, id, from_ins, to_outs): reads on the way from ins and to outs of a repeat, with the sets they are reached from and lead to.
    The searches go over contracted reads, and the labels of each go to all reads that it stands for. Without edges between reads the edges of ins and outs
    say it all."""
    ins, outs = repeats.select("rep_id", F.explode("ins").alias("x")), repeats.select("rep_id", F.explode("outs").alias("x"))
    turned = lambda df: df.select(c("dst").alias("src"), c("src").alias("dst"))
    through = c("id") >= contigs
    place = None
    if edges.where((c("src") >= contigs) & (c("dst") >= contigs)).limit(1).count():
        place, edges = contracted(edges, contigs)
        # what lies behind a contig is not asked for
        reached = lambda step, ends: shortest_paths(step.where(c("dst") >= contigs), ends.select(c("x").alias("id")).distinct(), through=through).select(c("source").alias("x"), "id")
    else:
        reached = lambda step, ends: step.select(c("src").alias("x"), c("dst").alias("id"))
    ahead = ins.join(reached(edges, ins), "x").where(through).select("rep_id", c("id").cast("long").alias("id"), c("x").alias("i"), F.lit(None).cast("long").alias("o"))
    back = outs.join(reached(turned(edges), outs), "x").where(through).select("rep_id", c("id").cast("long").alias("id"), F.lit(None).cast("long").alias("i"), c("x").alias("o"))
    labels = lambda k: F.array_sort(F.collect_set(k))
    both = ahead.union(back).groupBy("rep_id", "id").agg(labels("i").alias("i"), labels("o").alias("o"))
    both = both.select("rep_id", "id", F.when(F.size("i") > 0, c("i")).alias("from_ins"), F.when(F.size("o") > 0, c("o")).alias("to_outs"))
    return both if place is None else both.withColumnRenamed("id", "at").join(place.hint("merge"), "at").select("rep_id", "id", "from_ins", "to_outs")


def interior(labels: DataFrame, repeats: DataFrame) -> DataFrame:
    """labels with kind: inside (all ins and all outs), in_flank (all outs, one in), out_flank (all ins, one out), miss_in and miss_out (all but one)."""
    n = repeats.select("rep_id", F.size("ins").alias("ni"), F.size("outs").alias("no"))
    x = labels.join(n, "rep_id").withColumn("a", F.coalesce(F.size("from_ins"), F.lit(0))).withColumn("b", F.coalesce(F.size("to_outs"), F.lit(0)))
    kind = F.when((c("a") == c("ni")) & (c("b") == c("no")), "inside").when((c("a") == 1) & (c("b") == c("no")), "in_flank").when((c("b") == 1) & (c("a") == c("ni")), "out_flank").when((c("a") == c("ni") - 1) & (c("b") == c("no")), "miss_in").when((c("b") == c("no") - 1) & (c("a") == c("ni")), "miss_out").otherwise("other")
    return x.withColumn("kind", kind).drop("ni", "no", "a", "b")
