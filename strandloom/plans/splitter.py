"""Joining contigs through repeats: string graph, abundance, surgery, resolving, read-out; and joining by best neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import twin
from ..operators import aggregates as A
from ..operators import contraction as K
from ..operators import em
from ..operators import graph as G
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import resolve as R
from ..schemas import DOVETAIL, EDGE_LENGTH, EDGE_OVERLAP, EDGE_PATHS, SplitOptions
from .runtime import materialised
from .stages import Stages, unkept

c = F.col


def numbered(seqs: DataFrame, prefix: str) -> DataFrame:
    """(idx, name, seq, len, old): sequences in order of name, named prefix0, prefix1, ..."""
    rows = seqs.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(256)))
    base = rows.groupBy("_b").agg(F.count("*").alias("_k")).withColumn("_base", F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    idx = (c("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("name")) - 1).cast("long")
    return rows.join(base, "_b").select(idx.alias("idx"), F.concat(F.lit(prefix), idx).alias("name"), "seq", F.length("seq").alias("len"), c("name").alias("old"))


def aligned(refs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Alignment rows with lengths and with ref_idx and qry_idx."""
    number = lambda n: F.regexp_extract(n, "([0-9]+)$", 1).cast("long")
    lengths = refs.select("name", "len").union(queries.select("name", "len")).distinct()
    return J.with_lengths(J.align(refs, queries, k), lengths).withColumn("ref_idx", number("ref")).withColumn("qry_idx", number("qry"))


def surgery(edges: DataFrame, contigs: int, options: SplitOptions) -> DataFrame:
    """The contig graph: reach through reads, then the filters of edges in turn."""
    now = K.reach(edges, contigs).withColumn("wt", F.lit(0))
    now = materialised(G.without_adaptor_pairs(now))
    zone = materialised(G.no_go_zone(edges, now, edges.sparkSession.range(contigs), contigs))
    now = materialised(G.symmetric(now))
    if options.toRunCondenseRemove:
        now = materialised(G.remove(now, G.doubtful_links(now, edges, zone, EDGE_PATHS, EDGE_OVERLAP, EDGE_LENGTH)))
    if options.toRunDoublePtr:
        now = materialised(G.without_double(now))
    return materialised(G.transitive_reduction(now, int(options.kthres))) if options.toRunTransitive else now


def inherited(aln: DataFrame, edges: DataFrame, contigs: int, end: int = DOVETAIL) -> DataFrame:
    """edges and those that contigs inside a read inherit from it, for both strands. aln: alignments of reads on contigs with lengths and idx."""
    turned = c("s2") > c("e2")
    whole = aln.where((c("s1") <= end) & (c("e1") >= c("lr") - end)).select((c("ref_idx") * 2).alias("node"), (c("qry_idx") * 2 + F.when(turned, 1).otherwise(0) + contigs).alias("read_node"))
    both = whole.union(whole.select(twin("node"), twin("read_node"))).distinct()
    more = J.embedded_edges(both, edges.select("src", "dst", "wt"))
    return edges.select("src", "dst", "wt").union(more).groupBy("src", "dst").agg(F.max("wt").alias("wt"))


def reads_of_repeats(repeats: DataFrame, edges: DataFrame, contigs: int) -> DataFrame:
    """(rep_id, id): read nodes that overlap an in or an out of a repeat on the side of the repeat."""
    ins, outs = repeats.select("rep_id", F.explode("ins").alias("src")), repeats.select("rep_id", F.explode("outs").alias("dst"))
    behind = edges.where((c("src") < contigs) & (c("dst") >= contigs)).join(ins, "src").select("rep_id", c("dst").alias("id"))
    before = edges.where((c("dst") < contigs) & (c("src") >= contigs)).join(outs, "dst").select("rep_id", c("src").alias("id"))
    return behind.union(before).distinct()


def em_match(repeats: DataFrame, edges: DataFrame, contigs: int, seqs: DataFrame, depth: DataFrame) -> DataFrame:
    """(rep_id, l, r) that reads decide by expectation-maximisation. seqs (id, seq): oriented contigs and reads. What lies between an in and an out is the shortest way through
    reads; pairs without one are no templates. A repeat is taken on one strand, as the other has the same reads."""
    repeats = materialised(R.one_strand(repeats))
    pairs = em.every_pair(repeats)
    middles = materialised(R.gap_contents(R.paths_between(materialised(pairs.select("l", "r").distinct()), edges, contigs), seqs))
    reads = reads_of_repeats(repeats, edges, contigs).join(seqs, "id").select("rep_id", c("id").alias("read"), "seq")
    return em.resolve_by_em(repeats, seqs.where(c("id") < contigs), middles, reads, depth)


def split(contigs: DataFrame, reads: DataFrame, options: SplitOptions = SplitOptions(), k: int = 20, stages: Stages | None = None) -> DataFrame:  # noqa: B008
    """Joined contigs (node, seq). stages: where alignments and graphs are kept, so that a run that was stopped goes on behind the last one finished."""
    stage = stages or unkept
    con, rd = stage("contigs", lambda: numbered(contigs, "Contig"), contigs), stage("reads", lambda: numbered(reads, "Read"), reads)
    n = 2 * con.count()
    cc, cr = stage("contig_overlaps", lambda: aligned(con, con, k), con, options=k), stage("read_hits", lambda: aligned(con, rd, k), con, rd, options=k)
    edges = stage("string_graph", lambda: inherited(cr, R.string_graph(cc, cr, n), n), cc, cr)
    depth = stage("abundance", lambda: A.abundance(A.best_hit(cr), con.select("name", "len")), cr, con)
    node_depth = depth.withColumn("num", F.regexp_extract("contig", "([0-9]+)$", 1).cast("long")).select(F.explode(F.array(c("num") * 2, c("num") * 2 + 1)).alias("id"), "depth")
    sd = A.distinct_std(depth, "depth").first()["sd"] or 0.0
    graph = stage("contig_graph", lambda: surgery(edges, n, options) if options.runGraphSurgery else K.reach(edges, n).withColumn("wt", F.lit(0)), edges, options=options)
    if options.runBResolve:
        repeats = materialised(G.bipartite_repeats(graph).where("size(ins) > 0 and size(outs) > 0"))
        inner = repeats.where("size(ins) > 1 or size(outs) > 1")
        found = []
        if options.AbunB:
            found.append(R.abundance_match(inner, node_depth, float(sd), options.AbunLower, options.AbunUpper))
        if options.BRB:
            found.append(R.bridge_match(inner, edges, n, int(options.BRThres), both_ways=True))
        if options.EMB:
            found.append(em_match(inner, edges, n, materialised(R.oriented(con).union(R.oriented(rd).select((c("id") + n).alias("id"), "seq"))), node_depth))
        if found:
            pairs = materialised(R.resolved_pairs(*found).select(c("l").alias("src"), c("r").alias("dst"), F.lit(0).alias("wt")))
            touched = inner.join(pairs, F.array_contains("ins", c("src")), "left_semi")
            graph = materialised(G.bipartite_resolve(graph, touched, pairs))
    if options.runXResolve and options.AbunX:
        ways = materialised(R.x_nodes(graph, node_depth, float(sd), options.AbunLower, options.AbunUpperX))
        if ways.limit(1).count():
            first = 2 * (graph.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] or 0) + 2
            graph, copies = G.split_nodes(graph, ways, first)
        else:
            copies = None
    else:
        copies = None
    nodes, _ = G.condense(graph)
    if copies is not None:
        real = nodes.select("id", "overlaps", F.posexplode("members").alias("i", "m")).join(copies.select(c("copy").alias("m"), c("node").alias("real")), "m", "left")
        nodes = real.groupBy("id", "overlaps").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("real", "m").alias("m")))), lambda x: x["m"]).alias("members"))
    nodes = materialised(nodes.select("id", "members", "overlaps"))
    steps = nodes.select(F.explode(F.arrays_zip(F.slice("members", F.lit(1), F.greatest(F.size("members") - 1, F.lit(0))).alias("a"), F.slice("members", F.lit(2), F.greatest(F.size("members") - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = steps.select(c("p.a").alias("l"), c("p.b").alias("r")).where("l is not null and r is not null").distinct()
    seqs = materialised(R.oriented(con).union(R.oriented(rd).select((c("id") + n).alias("id"), "seq")))
    gaps = materialised(R.gap_contents(R.paths_between(materialised(pairs), edges, n), seqs))
    out = materialised(R.read_out(nodes, seqs.where(c("id") < n), gaps).select(F.concat(F.lit("Segkk"), "node").alias("name"), "seq"))
    own = J.with_lengths(J.align(out, out, k), out.select("name", F.length("seq").alias("len")))
    return R.without_redundant(out, own)


def finish(contigs: DataFrame, reads: DataFrame, k: int = 20) -> DataFrame:
    """Joining by best neighbours: redundancy, best successors and predecessors, gaps filled by one read, chains, read-out."""
    lengths = lambda df: df.select("name", F.length("seq").alias("len"))
    contigs = materialised(R.without_redundant(contigs, J.with_lengths(J.align(contigs, contigs, k), lengths(contigs))))
    con, rd = materialised(numbered(contigs, "Contig")), materialised(numbered(reads, "Read"))
    n = 2 * con.count()
    cc, cr = materialised(aligned(con, con, k)), materialised(aligned(con, rd, k))
    own = R.overlap_edges(cc, c("ref_idx") * 2, c("qry_idx") * 2).select("src", "dst", c("wt").alias("len"))
    out, into = A.best_links(own)
    direct = out.join(into.select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", c("len").alias("wt"))
    edges = materialised(R.string_graph(cc, cr, n))
    hops = edges.where(c("src") < n).where(c("dst") >= n).select(c("src").alias("l"), c("dst").alias("read"), c("wt").alias("a")).join(edges.where(c("dst") < n).select(c("src").alias("read"), c("dst").alias("r"), c("wt").alias("b")), "read")
    bridged = hops.where(F.floor(c("l") / 2) != F.floor(c("r") / 2)).groupBy("l", "r").agg(F.count("*").alias("k"), F.max(F.least("a", "b")).alias("wt")).where("k > 1")
    graph = materialised(G.symmetric(G.resolve_by_weight(direct.union(bridged.select(c("l").alias("src"), c("r").alias("dst"), "wt")).groupBy("src", "dst").agg(F.max("wt").alias("wt")))))
    nodes = materialised(G.condense(graph)[0])
    seqs = materialised(R.oriented(con).union(R.oriented(rd).select((c("id") + n).alias("id"), "seq")))
    gaps = R.gap_contents(R.paths_between(graph.select(c("src").alias("l"), c("dst").alias("r")), materialised(edges.unionByName(direct.select("src", "dst", c("wt").cast("int").alias("wt")))), n), seqs)
    return R.read_out(nodes, seqs.where(c("id") < n), materialised(gaps)).select(F.concat(F.lit("Segkk"), "node").alias("name"), "seq")


def fill_gaps(contigs: DataFrame, reads: DataFrame, open_ends: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(name, seq): contigs joined by one read each. Reads that hang on the right end of one contig and on the left end of another link the two, if both ends are
    open (open_ends: name, no_prev, no_next; all are without it) and no read links them elsewhere; of several reads that with the longest shorter overlap counts, of
    several links the heaviest first. Names of contigs in open_ends are theirs in contigs."""
    con, rd = materialised(numbered(contigs, "Contig")), materialised(numbered(reads, "Read"))
    n = 2 * con.count()
    edges = materialised(R.string_graph(aligned(con, con, k), aligned(con, rd, k), n))
    on = edges.where((c("src") < n) & (c("dst") >= n)).select(c("dst").alias("read"), c("src").alias("contig"), F.lit("R").alias("side"), c("wt").alias("len"))
    on = on.union(edges.where((c("dst") < n) & (c("src") >= n)).select(c("src"), c("dst"), F.lit("L"), c("wt")))
    if open_ends is not None:
        known = open_ends.join(con.select(c("old").alias("name"), "idx"), "name")
        ends = known.select((c("idx") * 2).alias("name"), "no_prev", "no_next").union(known.select(c("idx") * 2 + 1, c("no_next"), c("no_prev")))
        on, _ = R.usable_ends(on, ends)
    # read_bridges has the contig behind as l and the one before as r
    links = J.read_bridges(on.withColumnRenamed("contig", "node")).select(c("r").alias("l"), c("l").alias("r"), "read", "len")
    best = R.unique_partners(links).groupBy("l", "r").agg(F.max(F.struct("len", (-c("read")).alias("k"))).alias("m")).select("l", "r", c("m.len").cast("long").alias("wt"), (-c("m.k")).alias("read"))
    best = materialised(best)
    chosen = I.greedy_pairs(best.select("l", "r", "wt"))
    graph = materialised(G.symmetric(chosen.select(c("l").alias("src"), c("r").alias("dst"), "wt")))
    paths = best.join(graph.select(c("src").alias("l"), c("dst").alias("r")), ["l", "r"], "left_semi").select("l", "r", F.array("l", "read", "r").alias("path"))
    seqs = materialised(R.oriented(con).union(R.oriented(rd).select((c("id") + n).alias("id"), "seq")))
    gaps = materialised(R.gap_contents(paths, seqs))
    return R.read_out(materialised(G.condense(graph)[0]), seqs.where(c("id") < n), gaps).select(F.concat(F.lit("Segkk"), "node").alias("name"), "seq")
