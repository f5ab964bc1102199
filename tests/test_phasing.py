import pandas as pd
from pyspark.sql import functions as F

from strandloom.functions.alignment import aligned, edit_distance, log_likelihood, normalised
from strandloom.operators import aggregates as A
from strandloom.operators import phasing as P


def test_alignments():
    assert aligned("ACGT", "TTACGTTT")[0] == 4
    assert edit_distance("kitten", "sitting") == 3
    assert aligned("ACGT", "AGT", "global") == (2.0, "ACGT", "A-GT", 0, 4, 0, 3)
    assert aligned("ACGT", "TTACGTGG", "fixed")[5:] == (2, 6)
    assert normalised("AC-CT-", "ACCCT-") == ("A-CCT", "ACCCT")
    assert log_likelihood("ACGT", "ACGT", 0.1)[0] > log_likelihood("ACGT", "ACTT", 0.1)[0]


def test_matching_by_likelihood(spark):
    repeats = spark.createDataFrame([(0, [0, 2], [4, 6])], "rep_id long, ins array<long>, outs array<long>")
    side = {0: "AAAACCCC", 2: "GGGGTTTT", 4: "ACACACAC", 6: "GTGTGTGT"}
    sides = spark.createDataFrame(list(side.items()), "id long, seq string")
    middles = spark.createDataFrame([(a, b, "TGCATGCA") for a in (0, 2) for b in (4, 6)], "l long, r long, middle string")
    reads = spark.createDataFrame([(0, f"r{i}", s) for i, s in enumerate(["CCCCTGCATGCAGTGT", "CCCTGCATGCAGTGTG", "TTTTTGCATGCAACAC", "TTTGCATGCAACACA"])], "rep_id long, read string, seq string")
    depth = spark.createDataFrame([(k, 10.0) for k in side], "id long, depth double")
    got = {(r.l, r.r) for r in P.resolve_by_likelihood(repeats, sides, middles, reads, depth).collect()}
    assert got == {(0, 6), (2, 4)}


def test_consensus(spark):
    pairs = [("x", "ACGTACGT", "ACGTTCGT")] * 6 + [("x", "ACGTACGT", "ACGTACGT")] * 2
    v = P.pair_votes(spark.createDataFrame(pairs, "read string, seq string, other string"))
    edits = P.consensus_edits(v, "read")
    assert [tuple(r) for r in edits.collect()] == [("x", 5, "sub", 0, "T")]
    out = P.corrected(spark.createDataFrame([("x", "ACGTACGT"), ("y", "AA")], "read string, seq string"), edits)
    assert {r.read: r.seq for r in out.collect()} == {"x": "ACGTTCGT", "y": "AA"}
    assert [tuple(r) for r in P.differing_places(v, "read", least=8).collect()] == [("x", 5, "T", "A")]


def test_hypothesis(spark):
    rows = [("k", i, v, 0.0 if (i < 5) == (v == "A") else -20.0) for i in range(10) for v in "AB"] + [("m", i, v, 0.0 if v == "A" else -20.0) for i in range(10) for v in "AB"]
    got = {r.key: r.choice for r in P.hypothesis(spark.createDataFrame(rows, "key string, read int, variant string, ll double")).collect()}
    assert got == {"k": ["A", "B"], "m": ["A"]}


def test_phase(spark):
    v1, v2 = "ACGTACGTAC", "ACGTTCGTAC"
    rows = [(0, s, v1, v1, v2) for s in "lmr"] + [(1, "l", v1, v1, v2), (1, "m", v2, v1, v2), (1, "r", v1, v1, v2)]
    got = {r.rep_id: r.result for r in P.phase(spark.createDataFrame(rows, "rep_id long, side string, seq string, v1 string, v2 string")).collect()}
    assert got == {0: 0, 1: 1}


def test_small_parts(spark):
    assert P.base_graph_paths(pd.DataFrame({"pos": [1, 1, 2], "base": ["A", "C", "G"]})) == ["AG", "CG"]
    ring = spark.createDataFrame([(0, 10), (10, 11), (11, 12), (12, 10), (12, 2)], "src long, dst long")
    assert [r.id for r in P.tandem_cycles(ring, 4).orderBy("pos").collect()] == [10, 11, 12]
    assert P.tandem_cycles(spark.createDataFrame([(0, 10), (10, 2)], "src long, dst long"), 4).count() == 0
    aln = spark.createDataFrame([("a", 100), ("a", 60), ("b", 200)], "qry string, len1 int")
    assert P.copies(aln, 10, 10.0).first().copies == 3.0
    temps = spark.createDataFrame([(0, "A" * 120)], "t int, seq string")
    assert [len(r.seq) for r in P.binned(temps).orderBy("bin").collect()] == [50, 50, 20]
    assert P.variant_paths(spark.createDataFrame([(1, 1, "A"), (1, 1, "C"), (1, 2, "G")], "k int, pos int, base string"), "k").count() == 2
    assert F


def test_hypothesis_without_joins(spark):
    """A read's variants are told from one row; rows without a read count for single variants only."""
    rows = [("k", i, v, ll) for i in range(4) for v, ll in (("a", -1.0 - i % 2 * 9), ("b", -1.0 - (i + 1) % 2 * 9), ("c", -8.0))] + [("k", None, "c", -0.5), ("n", None, "x", -1.0)]
    out = P.hypothesis(spark.createDataFrame(rows, "key string, read int, variant string, ll double"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.key: r.choice for r in out.collect()} == {"k": ["a", "b"], "n": ["x"]}


def test_votes_without_windows(spark):
    """Places within a row: gaps at the begin, in the middle and at the end, and sequences of different length."""
    pairs = [("k", "--AC--G-", "TTACGTGA"), ("k", "ACG", "A-GT"), ("k", "ACGT", "ACG"), ("k", "A-C", "AGCT"), ("k", "--", "AC"), ("k", None, "AC"), ("k", "AC", None)]
    out = A.votes(spark.createDataFrame(pairs, "key string, a1 string, a2 string"), "key")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for _, a, b in pairs:
        place, start = 0, 0
        for i in range(max(len(a), len(b)) if a is not None and b is not None else 0):
            x, y = (s[i] if i < len(s) else None for s in (a, b))
            if x not in ("-", None):
                place, start = place + 1, i
            kind = "ins" if x == "-" else "del" if y == "-" else "same" if x == y else "sub"
            k = (place, kind, i - start if x == "-" else 0, y)
            want[k] = want.get(k, 0) + 1
    assert {(r.pos, r.kind, r.offset, r.base): r.n for r in out.collect()} == want
