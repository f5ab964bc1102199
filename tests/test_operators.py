import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import joins as J
from strandloom.operators import resolve as R
from strandloom.schemas import RepairOptions, SplitOptions


def spans(spark, rows):
    return spark.createDataFrame([("c", a, b) for a, b in rows], "grp string, s int, e int")


@pytest.mark.parametrize(
    ("rows", "want"),
    [([(1, 3), (4, 7), (2, 6)], [(1, 7)]), ([(1, 3), (4, 7)], [(1, 3), (4, 7)]), ([(1, 3), (2, 6)], [(1, 6)]), ([(1, 3), (9, 10), (2, 6)], [(1, 6), (9, 10)]), ([(1, 3), (3, 5)], [(1, 3), (3, 5)])],
)
def test_interval_union(spark, rows, want):
    assert sorted((r.s, r.e) for r in I.union(spans(spark, rows), "grp", "s", "e").collect()) == want


def test_minimal_cover(spark):
    rows = [(1, 10371), (10371, 18994), (19335, 33907), (27959, 33907)]
    got = sorted((r.s, r.e) for r in I.minimal_cover(spans(spark, rows), "grp", "s", "e", 30).collect())
    assert got == rows[:3]
    gaps = I.gaps(I.minimal_cover(spans(spark, rows), "grp", "s", "e", 30), "grp", "s", "e").collect()
    assert ("c", 18994, 19335, "gap") in {tuple(r) for r in gaps}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), min_size=1, max_size=25))
def test_cover_covers(spark, rows):
    rows = [(a, a + n) for a, n in rows]
    got = [(r.s, r.e) for r in I.minimal_cover(spans(spark, rows), "grp", "s", "e").collect()]
    inside = lambda x, ivs: any(a <= x <= b for a, b in ivs)
    assert all(inside(x / 2, got) == inside(x / 2, rows) for x in range(0, 110))
    assert set(got) <= set(rows)


def test_cut_and_spacing(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "AA")], "name string, seq string")
    cuts = spark.createDataFrame([("a", 3), ("a", 5), ("a", 99), ("a", 0)], "name string, at int")
    got = sorted((r.name, r.piece, r.seq) for r in I.cut(seqs, cuts).collect())
    assert got == [("a", 0, "ACG"), ("a", 1, "TA"), ("a", 2, "CGT"), ("b", 0, "AA")]
    row = spark.range(1).select(I.spaced(F.array(F.lit(9), F.lit(1), F.lit(4), F.lit(5)), 3).alias("x")).first()
    assert row.x == [1, 5, 9]


def test_sequence_functions(spark):
    row = spark.range(1).select(S.reverse_complement(F.lit("acgNxT")).alias("r"), S.end_pieces(F.lit("ABCDEFGH"), 2).alias("e"), S.codes(F.lit("ACGTN")).alias("c"), S.letters(F.array(F.lit(1), F.lit(3), F.lit(0), F.lit(2))).alias("l"), S.name_of(F.lit(13).cast("long"), 10).alias("n"), S.stitched(F.array(F.lit("ACG"), F.lit("CGT")), F.array(F.lit(0), F.lit(2))).alias("s")).first()
    assert tuple(row) == ("ANCGT", "ABGH", [1, 2, 3, 4, 5], "AG", "Read1_d", "ACGT")


def test_options():
    assert RepairOptions.parse("toRunAggressive=True sdMult=4").sdMult == 4
    with pytest.raises(KeyError):
        RepairOptions.load({"nothing": 1})
    with pytest.raises(ValueError):
        SplitOptions.load({"AbunLower": 3})


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    label = list(range(80))
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in G.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: label[x] for x in nodes}
    assert G.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_condense_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 6), (3, 4, 7), (3, 5, 8), (10, 11, 1), (11, 12, 1), (12, 10, 1)], "src long, dst long, wt int")
    nodes, outer = G.condense(edges)
    assert {r.id: (r.members, r.overlaps) for r in nodes.collect()} == {1: ([1, 2, 3], [0, 5, 6]), 4: ([4], [0]), 5: ([5], [0]), 10: ([10, 11, 12], [0, 1, 1])}
    assert {(r.src, r.dst) for r in outer.collect()} == {(1, 4), (1, 5), (10, 10)}


def test_split_nodes(spark):
    edges = spark.createDataFrame([(1, 3, 0), (2, 3, 0), (3, 4, 0), (3, 5, 0)], "src long, dst long, wt int")
    out, copies = G.split_nodes(edges, spark.createDataFrame([(3, 1, 4), (3, 2, 5)], "node long, src long, dst long"), 100)
    assert {(r.src, r.dst) for r in out.collect()} == {(1, 100), (100, 4), (2, 101), (101, 5)}
    assert {tuple(r) for r in copies.collect()} == {(100, 3), (101, 3)}


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (9, 1)], "src long, dst long")
    got = {(r.id, r.dist, r.parent) for r in G.shortest_paths(edges, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 3)}


def test_ways_through_many_reads(spark):
    """Contigs 0 and 2 are joined by 22 reads in a row; 0 and 3 by none, which is said."""
    way = [0, *range(10, 32), 2]
    edges = spark.createDataFrame(list(zip(way[:-1], way[1:], strict=True)), "src long, dst long")
    pairs = spark.createDataFrame([(0, 2), (0, 3)], "l long, r long")
    with pytest.warns(UserWarning, match="1 pairs have no way"):
        got = R.paths_between(pairs, edges, 10)
    assert [tuple(x) for x in got.collect()] == [(0, 2, way)]
    repeats = spark.createDataFrame([(0, [0], [2])], "rep_id long, ins array<long>, outs array<long>")
    labels = {x.id: (x.from_ins, x.to_outs) for x in R.reach_labels(edges, repeats, 10).collect()}
    assert labels == {k: ([0], [2]) for k in way[1:-1]}


def test_reach_over_more_than_60_reads(spark, monkeypatch):
    monkeypatch.setattr(G, "materialised", lambda df: spark.createDataFrame(df.collect(), df.schema))
    way = [0, *range(10, 73), 2]
    edges = spark.createDataFrame(list(zip(way[:-1], way[1:], strict=True)), "src long, dst long").coalesce(1)
    assert [tuple(x) for x in G.reach_through_reads(edges, 10).collect()] == [(0, 2)]


def test_read_expansion(spark):
    """Reads 0, 1, 2, ... each lie on contigs i and i + 1: a round adds the next read, over any contig."""
    aln = spark.createDataFrame([(f"Contig{i + k}", f"r{i}") for i in range(5) for k in (0, 1)], "ref string, qry string")
    seeds = spark.createDataFrame([("r0",)], "qry string")
    got = lambda *a, **k: sorted(x.qry for x in R.expand_reads(aln, seeds, *a, **k).collect())
    assert got(0) == ["r0"] and got(1) == ["r0", "r1"] and got(3) == ["r0", "r1", "r2", "r3"]
    assert got(60) == [f"r{i}" for i in range(5)]
    assert got(60, among=F.col("ref") < "Contig3") == ["r0", "r1", "r2"]


def test_greedy_pairs_equal_one_at_a_time(spark):
    r = random.Random(3)
    pairs = list({(r.randrange(12), r.randrange(12)): r.randrange(6) for _ in range(60)}.items())
    rows = [(a, b, w) for (a, b), w in pairs]
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a), right.add(b)
    assert {(x.l, x.r) for x in I.greedy_pairs(spark.createDataFrame(rows, "l long, r long, wt long")).collect()} == want


def test_overlap():
    assert J.overlap_length("TTTTACGTACGTACGTAC", "ACGTACGTACGTACGGGG") == (14, 14)
    assert J.overlap_length("AAAA", "CCCC") == (0, 0)
    assert J.overlap_length("", "ACGT") == (0, 0)


def test_similarity_join(spark):
    r = random.Random(5)
    g = "".join(r.choice("ACGT") for _ in range(3000))
    turn = str.maketrans("ACGT", "TGCA")
    refs = spark.createDataFrame([("g", g)], "name string, seq string")
    reads = spark.createDataFrame([("f", g[500:900]), ("r", g[1000:1500][::-1].translate(turn)), ("m", g[2000:2200] + "A" + g[2201:2400]), ("x", "".join(r.choice("ACGT") for _ in range(400)))], "name string, seq string")
    got = {x.qry: (x.s1, x.e1, x.s2, x.e2) for x in J.align(refs, reads, k=20).collect()}
    assert got["f"] == (501, 900, 1, 400) and got["r"] == (1001, 1500, 500, 1) and got["m"] == (2001, 2400, 1, 400) and "x" not in got


def test_stream_matches_batch(spark, tmp_path):
    from strandloom.streaming.abundance import windowed

    rows = spark.createDataFrame([(i, f"2026-01-01 0{i % 5}:10:00", "abc"[i % 3], float(i)) for i in range(40)], "event_id long, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "event_type", "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("abundance_out").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("abundance_out")) == key(windowed(rows))
