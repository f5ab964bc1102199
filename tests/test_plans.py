import numpy as np

from strandloom.functions.stats import group_count_test, precision_recall
from strandloom.plans import evaluate
from strandloom.plans.repair import adaptor_breaks, fix, without_adaptors
from strandloom.plans.simulate import COMPLEMENT, genome, noisy, scenario, switching_counts, two_genomes
from strandloom.plans.splitter import split


def frame(spark, seqs, prefix):
    return spark.createDataFrame([(f"{prefix}{i}", s) for i, s in enumerate(seqs)], "name string, seq string")


def within(seq, genomes):
    return any(seq in g or seq[::-1].translate(COMPLEMENT) in g for g in genomes)


def test_two_genomes_are_cut_and_joined(spark):
    """Contigs swapped within a shared repeat become the two genomes again."""
    sc = two_genomes(20000, 1200, 600, 0.0, (50, 20), seed=3)
    cut = [r.seq for r in fix(frame(spark, sc.contigs, "C"), frame(spark, sc.reads, "R"), scale=0.05).collect()]
    assert len(cut) == 4 and all(within(s, sc.genomes) for s in cut)
    joined = [r.seq for r in split(frame(spark, cut, "C"), frame(spark, sc.reads, "R")).collect()]
    assert len(joined) == 2 and sorted(map(len, joined)) == [20000, 20000] and all(within(s, sc.genomes) for s in joined)


def test_adaptor(spark):
    rng = np.random.default_rng(1)
    body = genome(600, rng)
    contigs = frame(spark, [body + body[::-1].translate(COMPLEMENT), genome(500, rng)], "C")
    from strandloom.operators.joins import align, with_lengths

    own = with_lengths(align(contigs, contigs, 20, least=100), contigs.selectExpr("name", "length(seq) len"))
    found = adaptor_breaks(own, 50, 50, 100)
    assert [tuple(r) for r in found.collect()] == [("C0", 0, 600)]
    assert sorted(len(r.seq) for r in without_adaptors(contigs, found).collect()) == [500, 600]


def test_evaluation(spark):
    truth = spark.createDataFrame([("c", 100, 200), ("c", 500, 600)], "contig string, start int, end int")
    breaks = spark.createDataFrame([("c", 150), ("c", 160), ("c", 900)], "contig string, at int")
    row = evaluate.break_scores(breaks, truth).first()
    assert (row.tp, row.found, row.true) == (1, 3, 2) and abs(row.f1 - 0.4) < 1e-9
    assert precision_recall(0, 0, 0)[:2] == (1.0, 1.0)
    aln = spark.createDataFrame([("c", 1, 1000), ("c", 1200, 2000)], "ref string, s1 int, e1 int")
    assert [tuple(r) for r in evaluate.truth_ranges(aln).collect()] == [("c", 970, 1230)]


def test_simulation():
    rng = np.random.default_rng(2)
    g = genome(20000, rng)
    assert abs(len(noisy(g, 0.05, rng)) - 20000) < 400 and noisy(g, 0, rng) == g
    for name in ("LC_SR", "abunGap", "polyGap", "twoSplit", "SC_LR"):
        sc = scenario(name, 4000)
        assert sc.reads and sc.contigs
    counts, change = switching_counts(60, 20, 50, 0.1, np.random.default_rng(4))
    marks = group_count_test(counts.tolist(), [1] * 60)
    assert sum(m and c for m, c in zip(marks, change, strict=True)) >= 1
