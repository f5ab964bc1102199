import numpy as np

from strandloom.plans.phaser import phase_repeats, tandem_copies, variants
from strandloom.plans.repair import coverage_breaks, cut_extended
from strandloom.plans.simulate import genome, noisy


def test_phase_from_reads(spark):
    rng = np.random.default_rng(3)
    base = genome(120, rng)
    other = base[:30] + "ACGT"["TGCA".index(base[30])] + base[31:80] + "ACGT"["TGCA".index(base[80])] + base[81:]
    rows = []
    for i in range(8):
        rows += [(0, f"l{i}", "l", base), (0, f"m{i}", "m", other), (0, f"r{i}", "r", base)]
        rows += [(1, f"l{i}", "l", noisy(base, 0.01, rng)), (1, f"m{i}", "m", noisy(base, 0.01, rng)), (1, f"r{i}", "r", noisy(other, 0.01, rng))]
    reads = spark.createDataFrame(rows, "rep_id long, read string, side string, seq string")
    v = variants(reads.where("rep_id = 0").select("rep_id", "read", "seq")).first()
    assert {v.v1, v.v2} == {base, other}
    repeats = spark.createDataFrame([(0, [0, 2], [4, 6]), (1, [0, 2], [4, 6])], "rep_id long, ins array<long>, outs array<long>")
    got = {(r.rep_id, r.l, r.r) for r in phase_repeats(repeats, reads).collect()}
    assert got == {(0, 0, 4), (0, 2, 6), (1, 0, 6), (1, 2, 4)}


def test_tandem(spark):
    rng = np.random.default_rng(4)
    unit = genome(300, rng)
    g = genome(1000, rng) + unit * 4 + genome(1000, rng)
    reads = [g[i : i + 400] for i in rng.integers(0, len(g) - 400, 240)]
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(reads)], "name string, seq string")
    units = spark.createDataFrame([("u", unit)], "name string, seq string")
    depth = 240 * 400 / len(g)
    got = tandem_copies(units, df, depth).first().copies
    assert 2.5 < got < 5.5


def test_coverage_breaks(spark):
    rows = [("c", i, i + 100, 50 if i < 6000 else 10) for i in range(0, 13000, 100)]
    rows = [(a, s, e, d + (s // 100) % 3) for a, s, e, d in rows]
    depth = spark.createDataFrame(rows, "contig string, start int, end int, depth long")
    lengths = spark.createDataFrame([("c", 13000), ("short", 500)], "name string, len int")
    got = [(r.contig, r.at) for r in coverage_breaks(depth, lengths, t=200, multiple=5).collect()]
    assert len(got) == 1 and got[0][0] == "c" and abs(got[0][1] - 6000) <= 20


def test_two_sided_cut(spark):
    contigs = spark.createDataFrame([("a", "AAAACCCCGGGG"), ("b", "TT")], "name string, seq string")
    breaks = spark.createDataFrame([("a", 4, 6, "xx", "yy"), ("a", None, 9, None, "z")], "name string, left int, right int, left_more string, right_more string")
    got = sorted((r.name, r.piece, r.seq) for r in cut_extended(contigs, breaks).collect())
    assert got == [("a", 0, "AAAAxx"), ("a", 1, "yyCCG"), ("a", 2, "zGGG"), ("b", 0, "TT")]
