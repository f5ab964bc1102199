"""Links in doubt, bridging reads, gaps filled by reads, and small operators around them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import breaks as B
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import joins as J
from strandloom.operators import phasing as P
from strandloom.operators import resolve as R
from strandloom.plans import splitter
from strandloom.plans.repair import cut_extended, with_overhangs
from strandloom.plans.simulate import COMPLEMENT, genome
from strandloom.sources import tables


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, 0) for a, b in rows], "src long, dst long, wt int")


def test_doubtful_links(spark):
    """Contigs 0 to 6, reads from 100 on. 0-2 has many ways, 2-4 none and ends in doubt, 4-6 overlaps too far, 8-10 is fine."""
    reads = [(0, 100 + i) for i in range(5)] + [(100 + i, 2) for i in range(5)] + [(2, 200), (200, 4)]
    graph = edges_of(spark, [(0, 2), (2, 4), (4, 6), (8, 10)])
    both = spark.createDataFrame([(a, b, 0) for a, b in reads] + [(4, 6, 9000), (8, 10, 10)], "src long, dst long, wt int")
    zone = spark.createDataFrame([(0, "R"), (2, "R"), (10, "L")], "id long, side string")
    got = {(x.src, x.dst) for x in G.doubtful_links(graph, both, zone, 4, 5000, 5).collect()}
    assert got == {(2, 4), (4, 6), (8, 10)}
    counts = {(x.src, x.dst): x.n for x in G.walk_counts(both, graph, 5, 2).collect()}
    assert counts == {(0, 2): 5, (2, 4): 1, (4, 6): 0, (8, 10): 0}


def test_no_go_zone(spark):
    reads = edges_of(spark, [(0, 100), (0, 101), (2, 100), (2, 101), (4, 101), (101, 6)])
    zone = G.no_go_zone(reads, edges_of(spark, [(2, 6), (4, 6)]), spark.range(8), 100)
    assert {tuple(x) for x in zone.collect()} == {(2, "R")}


def test_reads_that_reach_one_contig(spark):
    """A long chain of reads to contig 3, and a read that reaches 3 and 5."""
    chain = [(100 + i, 101 + i) for i in range(20)] + [(120, 3), (300, 100), (300, 5)]
    got = {tuple(x) for x in R.sole_contig(edges_of(spark, chain), 10).collect()}
    assert got == {(100 + i, 3) for i in range(21)}


def test_bridges_both_ways(spark):
    """Reads 100 and 101 bridge 0 to 4; 102 does too, but leads to contig 8 by way of read 103."""
    e = edges_of(spark, [(0, 100), (100, 4), (0, 101), (101, 4), (0, 102), (102, 4), (102, 103), (103, 8), (2, 104), (104, 6)])
    rep = spark.createDataFrame([(0, [0, 2], [4, 6])], "rep_id long, ins array<long>, outs array<long>")
    got = lambda **k: {tuple(x) for x in R.bridge_match(rep, e, 100, **k).collect()}
    assert got(least=2) == {(0, 0, 4, 3)} and got(least=2, both_ways=True) == {(0, 0, 4, 2)}


def test_long_ways(spark, monkeypatch):
    """Chains of more than 60 nodes: every loop goes to the end."""
    monkeypatch.setattr(G, "materialised", lambda df, *_: spark.createDataFrame(df.collect(), df.schema).coalesce(1))
    chain = [(i, i + 1) for i in range(64)]
    e = edges_of(spark, chain)
    assert G.shortest_paths(e, spark.createDataFrame([(0,)], "id long")).agg(F.max("dist")).first()[0] == 64
    assert {x.component for x in G.components(e).collect()} == {0}
    assert {x.pos for x in G.chains(e).collect()} == set(range(65))
    # weights rise along a ladder, so a pair commits only after the one above it
    pairs = spark.createDataFrame([(i // 2, (i + 1) // 2, i) for i in range(140)], "l long, r long, wt long")
    assert I.greedy_pairs(pairs).count() == 70


@pytest.mark.parametrize("heavy", [1, 1000])
def test_components_of_hubs(spark, heavy, monkeypatch):
    monkeypatch.setattr(G, "HEAVY", heavy)
    monkeypatch.setattr(G, "_contract", lambda batches: batches)
    r = random.Random(heavy)
    rows = [(0, i) for i in range(1, 60)] + [(100 + i, 50 + i) for i in range(20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    label = list(range(300))
    for _ in range(300):
        for a, b in rows:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in G.components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {x: label[x] for e in rows for x in e}


def test_first_paths_and_lengths(spark):
    e = spark.createDataFrame([(0, 11, 3), (11, 2, 4), (0, 10, 5), (10, 12, 1), (12, 2, 2), (0, 4, 1), (4, 2, 1)], "src long, dst long, wt int")
    paths = G.first_paths(spark.createDataFrame([(0, 2), (2, 0)], "l long, r long"), e, 10)
    assert [tuple(x) for x in paths.collect()] == [(0, 2, [0, 10, 12, 2])]
    lengths = spark.createDataFrame([(i, 100) for i in (0, 2, 10, 12)], "id long, len int")
    assert [tuple(x) for x in G.path_lengths(paths, lengths, e).collect()] == [(0, 2, 392)]


def test_strands_and_pairs_of_paths(spark):
    kind = "rep_id long, ins array<long>, outs array<long>"
    reps = spark.createDataFrame([(1, [0, 2], [4, 6]), (2, [5, 7], [1, 3]), (3, [8], [10])], kind)
    assert sorted(tuple(x) for x in R.one_strand(reps).collect()) == [(1, [0, 2], [4, 6]), (3, [8], [10])]
    paths = spark.createDataFrame([(1, 0, 4), (1, 0, 6), (1, 2, 4), (2, 0, 4), (2, 2, 4)], "rep_id long, l long, r long")
    assert [tuple(x) for x in R.separate_paths(paths).collect()] == [(1, 0, 6, 2, 4)]
    long = R.long_contig_edges(edges_of(spark, [(0, 2), (0, 1), (2, 4)]), spark.createDataFrame([(0, 3000), (1, 2000), (2, 1999)], "idx long, len int"))
    assert [(x.src, x.dst) for x in long.collect()] == [(0, 2)]


def test_sequence_columns(spark):
    df = spark.createDataFrame([("ACGTACGT", "ACCTACGA"), ("AAAA", "AAAA"), ("", "")], "a string, b string")
    got = [tuple(x.k) for x in df.select(S.around_last_difference("a", "b", 2).alias("k")).collect()]
    assert got == [("CGT", "CGA"), ("AA", "AA"), ("", "")]
    df = spark.createDataFrame([("GTTTTTCAC", i) for i in range(1, 10)], "s string, p int")
    assert [x.p for x in df.where(S.beside_run("s", "p")).collect()] == [1, 7]
    long, short = S.by_length(spark.createDataFrame([("a", "ACGT"), ("b", "AC"), ("c", None)], "name string, seq string"), 3)
    assert [x.name for x in long.collect()] == ["a"] and sorted(x.name for x in short.collect()) == ["b", "c"]


def test_overlap_of_long_sequences():
    import time

    r = random.Random(2)
    a = "".join(r.choice("ACGT") for _ in range(50_000))
    began = time.time()
    assert J.overlap_length(a, a[20_000:] + "".join(r.choice("ACGT") for _ in range(9000))) == (30_000, 30_000)
    assert J.overlap_length("ACACACAC", "ACAC") == (4, 4) and J.overlap_length("ACACACAC", "ACACGG") == (0, 0)
    assert time.time() - began < 2


def test_peaks_one_at_a_time(spark):
    r = random.Random(4)
    rows = [("g", h, r.choice([-1, 1]) * r.randrange(1, 40) / 2) for h in range(300)]
    taken = []
    for _, h, v in sorted(rows, key=lambda x: (-abs(x[2]), x[1])):
        if abs(v) > 3 and all(abs(h - k) > 7 for k in taken):
            taken.append(h)
    got = I.peaks(spark.createDataFrame(rows, "g string, h int, v double"), "g", "h", "v", 3, 7)
    assert sorted(x.h for x in got.collect()) == sorted(taken)


def test_weight_resolution_one_at_a_time(spark):
    r = random.Random(5)
    rows = list({(r.randrange(30), r.randrange(30)): r.randrange(9) for _ in range(120)}.items())
    rows = [(a, b, w) for (a, b), w in rows]
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a), right.add(b)
    got = G.resolve_by_weight(spark.createDataFrame(rows, "src long, dst long, wt int"))
    assert {(x.src, x.dst) for x in got.collect()} == want


def test_read_out_does_not_glue(spark):
    """Where nothing is known to lie between two members, the sequence ends."""
    nodes = spark.createDataFrame([(0, [0, 2, 4], [0, 0, 0])], "id long, members array<long>, overlaps array<int>")
    seqs = spark.createDataFrame([(0, "AAAA"), (2, "CCCC"), (4, "GGGG"), (1, "TTTT"), (3, "GGGG"), (5, "CCCC")], "id long, seq string")
    gaps = spark.createDataFrame([(0, 2, 1, "TT")], "l long, r long, start int, middle string")
    got = {tuple(x) for x in R.read_out(nodes, seqs, gaps).collect()}
    assert got == {("0", "AAAATTCCC"), ("0_1", "GGGG")}


def frame(spark, seqs, prefix):
    return spark.createDataFrame([(f"{prefix}{i}", s) for i, s in enumerate(seqs)], "name string, seq string")


def test_gaps_are_filled_by_single_reads(spark):
    rng = np.random.default_rng(8)
    g = genome(4000, rng)
    contigs = [g[:1000], g[1100:2400], g[2500:]]
    reads = [g[800:1300], g[2200:2700][::-1].translate(COMPLEMENT), g[100:600]]
    whole = [x.seq for x in splitter.fill_gaps(frame(spark, contigs, "C"), frame(spark, reads, "R")).collect()]
    assert len(whole) == 1 and whole[0] in (g, g[::-1].translate(COMPLEMENT))
    closed = spark.createDataFrame([("C0", True, False), ("C1", True, True), ("C2", True, True)], "name string, no_prev boolean, no_next boolean")
    some = sorted(len(x.seq) for x in splitter.fill_gaps(frame(spark, contigs, "C"), frame(spark, reads, "R"), closed).collect())
    assert some == [1000, 2900]


def test_joining_by_best_neighbours(spark):
    """Overlapping contigs, one inside another: one contig is left, as the flow of the core expects for a single genome."""
    rng = np.random.default_rng(9)
    g = genome(3000, rng)
    contigs = [g[:1200], g[1000:2200], g[2000:], g[1300:1500]]
    got = [x.seq for x in splitter.finish(frame(spark, contigs, "C"), frame(spark, [g[900:1400], g[1900:2400]], "R")).collect()]
    assert len(got) == 1 and got[0] in (g, g[::-1].translate(COMPLEMENT))


def test_embedded_contigs_inherit_edges(spark):
    """Contig 1 lies in read 0, whose neighbours become its own, on both strands."""
    aln = spark.createDataFrame([(1, 100, 50, 149, 100, 500, 1, 0), (1, 90, 1, 90, 100, 500, 2, 1)], "s1 int, e1 int, s2 int, e2 int, lr int, lq int, ref_idx long, qry_idx long")
    e = spark.createDataFrame([(0, 10, 40), (10, 4, 30)], "src long, dst long, wt int")
    got = {tuple(x) for x in splitter.inherited(aln, e, 10).collect()}
    assert got == {(0, 10, 40), (10, 4, 30), (0, 2, 40), (2, 4, 30)}


def test_overhangs(spark):
    rng = np.random.default_rng(10)
    a, b, x, y = genome(300, rng), genome(300, rng), genome(50, rng), genome(60, rng)
    contigs = frame(spark, [a + b], "C")
    reads = spark.createDataFrame([("l", a[-80:] + x), ("r", y + b[:70]), ("n", genome(90, rng))], "name string, seq string")
    breaks = spark.createDataFrame([("C0", 300, 300, "l", "r"), ("C0", 310, 310, "n", None)], "name string, left int, right int, left_read string, right_read string")
    out = with_overhangs(contigs, breaks, reads)
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(300, 300, x, y), (310, 310, None, None)]
    pieces = [r.seq for r in cut_extended(contigs, out.where("left = 300")).orderBy("piece").collect()]
    assert pieces == [a + x, y + b]


def test_reads_are_cleaned(spark):
    rng = np.random.default_rng(11)
    base = genome(80, rng)
    bad = base[:40] + "ACGT"["TGCA".index(base[40])] + base[41:]
    reads = spark.createDataFrame([(0, f"r{i}", base) for i in range(7)] + [(0, "x", bad), (1, "y", base[:30])], "rep_id long, read string, seq string")
    got = {x.read: x.seq for x in P.cleaned(reads).collect()}
    assert got == {**{f"r{i}": base for i in range(7)}, "x": base, "y": base[:30]}


def test_coordinate_map(spark):
    pairs = spark.createDataFrame([("k", "AC-GT", "A-TGT")], "k string, a1 string, a2 string")
    assert sorted(tuple(x) for x in P.coordinate_map(pairs, "k").collect()) == [("k", 1, 1), ("k", 2, None), ("k", 3, 3), ("k", 4, 4)]


def test_tables_as_csv(spark, tmp_path):
    v = P.pair_votes(spark.createDataFrame([("x", "ACGT", "AC-T")], "read string, seq string, other string")).select("read", F.col("pos").cast("long"), "kind", F.col("offset").cast("int"), "base", "n")
    tables.write_table(v, f"{tmp_path}/v")
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/v").collect())) == sorted(map(tuple, v.collect()))
    s = spark.createDataFrame([("c", 0, 10.0, 5)], tables.SEGMENTS)
    tables.write_table(s, f"{tmp_path}/s", tables.SEGMENTS)
    assert [tuple(x) for x in tables.read_table(spark, f"{tmp_path}/s", tables.SEGMENTS).collect()] == [("c", 0, 10.0, 5)]


def test_cut_list(spark):
    seg = spark.createDataFrame([("c", 0, 10), ("c", 1, 25), ("c", 2, 40), ("d", 0, 9)], "contig string, seg_idx int, end int")
    p = spark.createDataFrame([("c", 0, 1), ("c", 1, 0), ("c", 2, 0), ("d", 0, 0)], "contig string, seg_idx int, p int")
    assert sorted(map(tuple, B.cut_list(seg, p).collect())) == [("c", 0), ("c", 10), ("c", 40), ("d", 0), ("d", 9)]


def test_walks_are_counted_for_links_that_may_go(spark, monkeypatch):
    """Walks are counted once, and only from single links in a doubtful zone or with a long overlap."""
    asked = []
    plain = G.walk_counts
    monkeypatch.setattr(G, "walk_counts", lambda edges, pairs, *a: asked.append({tuple(x) for x in pairs.select("src", "dst").collect()}) or plain(edges, pairs, *a))
    graph = edges_of(spark, [(0, 2), (2, 4), (4, 6), (8, 10), (12, 14)])
    both = spark.createDataFrame([(4, 6, 9000), (8, 10, 10), (0, 100, 0), (100, 2, 0), (0, 101, 0), (101, 2, 0)], "src long, dst long, wt int")
    zone = spark.createDataFrame([(0, "R"), (10, "L")], "id long, side string")
    assert {tuple(x) for x in G.doubtful_links(graph, both, zone, 1, 5000, 4).collect()} == {(4, 6), (8, 10)}
    assert asked == [{(0, 2), (4, 6), (8, 10)}]
