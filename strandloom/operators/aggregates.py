"""Best hits, abundance, coverage, support counts and other grouped results. Every tie is broken by named columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GAP_READS

c = F.col


def best_hit(aln: DataFrame) -> DataFrame:
    """One row per read: the largest identity times length; ties go to the smaller ref, then start."""
    rank = F.row_number().over(Window.partitionBy("qry").orderBy((c("idy") / 100 * c("len1")).desc(), "ref", "s1", "s2"))
    return aln.withColumn("_n", rank).where("_n = 1").drop("_n")


def abundance(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Depth of each contig (name, len): the whole lengths (lq) of reads whose best hit it is, by its length; 0 without any."""
    total = hits.groupBy(c("ref").alias("name")).agg(F.sum("lq").alias("bases"))
    return lengths.join(total, "name", "left").select(c("name").alias("contig"), (F.coalesce("bases", F.lit(0)) / c("len")).alias("depth"))


def unmapped(reads: DataFrame, aln: DataFrame) -> DataFrame:
    return reads.join(aln.select(c("qry").alias("name")).distinct(), "name", "left_anti")


def missed_share(reads: DataFrame, aln: DataFrame) -> DataFrame:
    """One row: shares of reads and of bases that have no alignment."""
    mapped = aln.select(c("qry").alias("name"), F.lit(1).alias("m")).distinct()
    both = reads.join(mapped, "name", "left")
    miss = c("m").isNull()
    return both.agg((F.count_if(miss) / F.count("*")).alias("reads"), (F.sum(F.when(miss, c("len")).otherwise(0)) / F.sum("len")).alias("bases"))


def placement(aln: DataFrame, *accepted) -> DataFrame:
    """One accepted row per read, picked by hash: the same choice in every run."""
    rows = aln
    for a in accepted:
        rows = rows.where(a)
    rank = F.row_number().over(Window.partitionBy("qry").orderBy(F.xxhash64("qry", "ref", "s1"), "ref", "s1", "s2"))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


def depth_segments(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Segments (group, start, end: half-open, depth > 0) from closed-open spans: a sweep over +1 and -1 events, never a row per base."""
    events = spans.select(c(group), F.explode(F.array(F.struct(c(start).alias("at"), F.lit(1).alias("d")), F.struct(c(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(group, c("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(group).orderBy("at")
    out = steps.withColumn("depth", F.sum("d").over(w)).withColumn("end", F.lead("at").over(w))
    return out.where("depth > 0").select(group, c("at").alias("start"), "end", c("depth").cast("long").alias("depth"))


def depth_in_ranges(segments: DataFrame, ranges: DataFrame, group: str, width: int) -> DataFrame:
    """Sum of depth times overlap in each range (group, rs, re: half-open), by bins of `width` on both sides."""
    bins = lambda s, e: F.sequence(F.floor(c(s) / width), F.floor((c(e) - 1) / width))
    r = ranges.select(group, "rs", "re").distinct().where("re > rs").withColumn("_b", F.explode(bins("rs", "re")))
    s = segments.select(c(group).alias("_g"), "start", "end", "depth", F.explode(bins("start", "end")).alias("_c"))
    on = (c(group) == c("_g")) & (c("_b") == c("_c"))
    low = F.greatest("rs", "start", c("_b") * width)
    high = F.least("re", "end", (c("_b") + 1) * width)
    got = r.join(s, on).groupBy(group, "rs", "re").agg(F.sum(F.greatest(F.lit(0), high - low) * c("depth")).alias("total"))
    return ranges.select(group, "rs", "re").distinct().join(got, [group, "rs", "re"], "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))


def best_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best successor of each src and best predecessor of each dst: longest, ties to the larger name."""
    out = links.groupBy("src").agg(F.max(F.struct("len", "dst")).alias("m")).select("src", "m.dst", "m.len")
    into = links.groupBy("dst").agg(F.max(F.struct("len", "src")).alias("m")).select("m.src", "dst", "m.len")
    return out, into


def support(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(l, r, n) of pairs seen so often at least."""
    return pairs.groupBy("l", "r").agg(F.count("*").alias("n")).where(c("n") >= least)


def reads_on_ends(hits: DataFrame, most: int = GAP_READS) -> DataFrame:
    """Names of reads with two hits or more on contig ends: the first so many by name, which is the feature."""
    return hits.groupBy("qry").agg(F.count("*").alias("n")).where("n > 1").orderBy("qry").limit(most)


def conflict_free(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (l, r) whose l and r each occur in no other pair."""
    one = pairs.select("l", "r").distinct()
    bad_l, bad_r = (one.groupBy(k).agg(F.count("*").alias("n")).where("n > 1").select(k) for k in ("l", "r"))
    return one.join(bad_l, "l", "left_anti").join(bad_r, "r", "left_anti").select("l", "r")


def distinct_std(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.stddev_pop(column).alias("sd"))


def interquartile_std(values: DataFrame, column: str) -> DataFrame:
    """Population standard deviation of the values from the first to the third quartile (exact, linear)."""
    q = values.agg(F.percentile(column, F.lit(0.25)).alias("lo"), F.percentile(column, F.lit(0.75)).alias("hi"))
    return values.join(F.broadcast(q), (c(column) >= c("lo")) & (c(column) <= c("hi"))).agg(F.stddev_pop(column).alias("sd"))  # one row


def node_depth(nodes: DataFrame, depth: DataFrame, lengths: DataFrame) -> DataFrame:
    """Depth of a merged node (id, members): that of its longest member (node id // 2 is the contig's number)."""
    each = nodes.select("id", F.explode("members").alias("m")).withColumn("contig", F.concat(F.lit("Contig"), F.floor(c("m") / 2)))
    full = each.join(depth, "contig").join(lengths.select(c("name").alias("contig"), "len"), "contig")
    return full.groupBy("id").agg(F.max_by("depth", F.struct("len", "m")).alias("depth"))


def mixing_shares(matched: DataFrame, template: str, bases: str) -> DataFrame:
    """Share of matched bases of each template."""
    total = matched.groupBy(template).agg(F.sum(bases).alias("bases"))
    return total.withColumn("lambda", c("bases") / F.sum("bases").over(Window.partitionBy(F.lit(1)))).drop("bases")


def votes(pairs: DataFrame, key: str, a1: str = "a1", a2: str = "a2") -> DataFrame:
    """Votes (key, pos on a1 without gaps, kind sub, ins, del or same, offset in an insertion, base, n) of aligned pairs (gap: -)."""
    z = F.arrays_zip(F.split(c(a1), "").alias("x"), F.split(c(a2), "").alias("y"))
    # places are counted within the row: a piece begins at each letter of a1 (the first one, with place 0, at the begin) and goes up to the next
    rows = pairs.select(key, z.alias("z"), F.contains(c(a1), F.lit("-")).alias("gaps"))
    starts = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(0), F.size("z") - 1), lambda i: c("z")[i]["x"] != "-"), F.array(F.size("z")))
    vote = lambda e, pos, offset: F.struct(pos.cast("long").alias("pos"), offset.alias("offset"), e["x"].alias("x"), e["y"].alias("y"))
    piece = lambda a, k: F.transform(F.slice("z", a + 1, c("at")[k + 1] - a), lambda e, o: vote(e, k, F.when(e["x"] == "-", o).otherwise(0)))
    pieces = F.flatten(F.transform(F.slice("at", F.lit(1), F.size("at") - 1), piece))
    plain = F.transform("z", lambda e, i: vote(e, i + 1, F.lit(0)))
    # without gaps a letter's place is its number; a1 that ends before a2 has pieces as well
    rows = rows.where(F.size("z") > 0).withColumn("at", F.when(c("gaps") | F.element_at("z", -1)["x"].isNull(), starts))
    each = rows.select(key, F.explode(F.when(c("at").isNull(), plain).otherwise(pieces)).alias("e")).select(key, "e.*")
    kind = F.when(c("x") == "-", "ins").when(c("y") == "-", "del").when(c("x") == c("y"), "same").otherwise("sub")
    return each.groupBy(key, "pos", kind.alias("kind"), "offset", c("y").alias("base")).agg(F.count("*").alias("n"))


def majority(rows: DataFrame, key: str, pos: str, base: str) -> DataFrame:
    """Most frequent base at each place; ties to the smaller."""
    n = rows.groupBy(key, pos, base).agg(F.count("*").alias("n"))
    return n.groupBy(key, pos).agg(F.min(F.struct((-c("n")).alias("m"), c(base).alias("b"))).alias("t")).select(key, pos, c("t.b").alias(base), (-c("t.m")).alias("n"))


def best_extra(links: DataFrame) -> DataFrame:
    """Per (start, end) number of links and the read with the best shorter length."""
    m = F.least("l1", "l2")
    return links.groupBy("start", "end").agg(F.count("*").alias("n"), F.max(F.struct(m.alias("len"), c("read"))).alias("t")).select("start", "end", "n", "t.read", "t.len")
