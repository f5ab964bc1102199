import math
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import forward
from strandloom.functions.alignment import log_likelihood
from strandloom.operators import partial_order
from strandloom.operators.partial_order import bin_consensus, consensus


def every_way(a, b, p):
    """Probabilities of all alignments of a with a part of b, one by one."""
    cost = {"same": (1 - p) ** 2, "sub": p * p / 3, "ins": p / 3, "del": p}

    @lru_cache(None)
    def ways(i, j):
        if not i:
            return (1.0,)
        out = [w * cost["del"] for w in ways(i - 1, j)]
        if j:
            out += [w * cost["same" if a[i - 1] == b[j - 1] else "sub"] for w in ways(i - 1, j - 1)] + [w * cost["ins"] for w in ways(i, j - 1)]
        return tuple(out)

    return [w for j in range(len(b) + 1) for w in ways(len(a), j)]


def test_sums_equal_enumeration():
    r = random.Random(1)
    pairs = [("", ""), ("", "AC"), ("AC", ""), ("A", "A")] + [tuple("".join(r.choice("ACG") for _ in range(r.randrange(6))) for _ in range(2)) for _ in range(60)]
    p = np.array([r.choice([0.01, 0.1, 0.3]) for _ in pairs])
    for (a, b), q, got in zip(pairs, p, forward.sums([x for x, _ in pairs], [y for _, y in pairs], p), strict=True):
        want = every_way(a, b, q)
        best = max(want)
        assert got == pytest.approx([math.log(sum(want)), math.log(best), sum(w >= best * (1 - 1e-9) for w in want), math.log(len(want))])


def test_blocks_and_bands(monkeypatch):
    r = random.Random(2)
    a = ["".join(r.choice("ACGT") for _ in range(r.randrange(1, 40))) for _ in range(50)]
    b = ["".join(r.choice("ACGT") for _ in range(r.randrange(1, 40))) for _ in range(50)]
    p = np.full(50, 0.05)
    whole = forward.sums(a, b, p)
    monkeypatch.setattr(forward, "BLOCK", 60)
    assert forward.sums(a, b, p) == pytest.approx(whole)
    assert forward.sums(a, b, p, band=100) == pytest.approx(whole)
    assert all(x[0] <= y[0] + 1e-9 for x, y in zip(forward.sums(a, b, p, band=5), whole, strict=True))
    for x, y, w in zip(a, b, whole, strict=True):
        best, ways = log_likelihood(x, y, 0.05)
        assert (w[1] + math.log(w[2]), w[2]) == pytest.approx((best, ways)) and w[0] >= w[1]


def test_column(spark):
    df = spark.createDataFrame([("ACGT", "TACGTT"), (None, "A"), ("é中", "é中")], "a string, b string")
    rows = df.withColumn("s", forward.alignment_sums()("a", "b", F.lit(0.1))).collect()
    assert all(x.s.total >= x.s.best for x in rows) and rows[2].s.best == pytest.approx(4 * math.log(0.9))


def test_consensus_keeps_what_most_have():
    assert consensus([("ACGTACGT", 5)]) == "ACGTACGT"
    assert consensus([("ACGTACGT", 3), ("ACGTTACGT", 4)]) == "ACGTTACGT"
    assert consensus([("ACGTACGT", 4), ("ACGTTACGT", 3)]) == "ACGTACGT"
    assert consensus([("ACGACGT", 4), ("ACGTACGT", 3)]) == "ACGACGT"
    assert consensus([("", 3), ("A", 1)]) == "" and consensus([("", 1), ("A", 3)]) == "A"
    # each has another letter wrong
    word = "GATTACAGATTACA"
    wrong = [word[:i] + ("C" if word[i] != "C" else "G") + word[i + 1 :] for i in range(len(word))]
    assert consensus([(w, 1) for w in wrong]) == word


def test_noisy_segments():
    """Insertions, deletions and substitutions at a tenth of places: the segment that was read comes out."""
    r = random.Random(3)

    def noisy(s):
        out = []
        for x in s:
            k = r.random()
            out.append("" if k < 0.03 else r.choice("ACGT") if k < 0.06 else x + r.choice("ACGT") if k < 0.09 else x)
        return "".join(out)

    right = 0
    for _ in range(20):
        word = "".join(r.choice("ACGT") for _ in range(50))
        right += consensus([(noisy(word), 1) for _ in range(25)]) == word
    assert right >= 18


def test_insertion_that_votes_on_a_template_miss(spark):
    """The template lacks four letters that all reads have, and each read has one letter wrong somewhere: votes by pairs put the insertion at several places."""
    from strandloom.operators import phasing as P

    truth, template = "ACCATTGGAGATCGTTAC", "ACCATTGGAGTTAC"
    reads = [truth[:i] + ("A" if truth[i] != "A" else "T") + truth[i + 1 :] for i in range(6, 15)]
    rows = spark.createDataFrame([(1, k, template, s) for k, s in enumerate(reads)] + [(2, 0, "AAA", "AAA"), (2, 1, "AAA", None)], "bin int, read int, template string, seg string")
    got = {x.bin: x.seq for x in bin_consensus(rows, ["bin"]).collect()}
    assert got[1] == truth and got[2] in ("AAA", "")
    voted = P.bin_consensus(rows.where("bin = 1"), ["bin"]).first().seq
    assert voted != truth


def test_segments_near_the_graph_need_no_rows(monkeypatch):
    """Every letter of a word wrong in every way, as in the query's bins: cells near the way of least cost are enough, and other bounds give the same graph."""
    r = random.Random(4)
    bins = []
    for _ in range(20):
        word = "".join(r.choice("ACGT") for _ in range(8))
        bins.append([(word, 9)] + [(word[:i] + x + word[i + 1 :], r.randrange(1, 9)) for i in range(8) for x in "ACGT" if x != word[i]])
    monkeypatch.setattr(partial_order, "CELLS", 0)
    want = [consensus(b) for b in bins]
    monkeypatch.undo()
    monkeypatch.setattr(partial_order.Graph, "rows", lambda *_: pytest.fail("all cells were computed"))
    assert [consensus(b) for b in bins] == want


@pytest.mark.parametrize("cells", [0, 3, 8, 10**6])
def test_alignment_costs_least(monkeypatch, cells):
    """Of any segment with any graph, by a plain table; the graph is the same whatever is searched."""
    monkeypatch.setattr(partial_order, "CELLS", cells)
    r = random.Random(5)
    for _ in range(60):
        graph, word = partial_order.Graph(), "".join(r.choice("ACG") for _ in range(r.randrange(12)))
        for _ in range(8):
            seq = "".join(r.choice(["", x, x, x, x, x + r.choice("ACG"), r.choice("ACG")]) for x in word)
            if graph.last:

                @lru_cache(None)
                def least(v, j, seq=seq, graph=graph):
                    if not v:
                        return 2 * j
                    out = [least(u, j) + 1 for u in graph.before[v]] + ([least(v, j - 1) + 2] if j else [])
                    return min(out + [least(u, j - 1) + (0 if graph.letter[v] == seq[j - 1] else 2) for u in graph.before[v] if j])

                pairs = graph.aligned(seq)
                assert [j for _, j in pairs if j >= 0] == list(range(len(seq)))
                way = [v for v, _ in pairs if v]
                assert all(u in graph.before[v] for u, v in zip([0] + way, way, strict=False)) and (way or [0])[-1] in graph.last
                paid = sum(2 if not v else 1 if j < 0 else 0 if graph.letter[v] == seq[j] else 2 for v, j in pairs)
                assert paid == min(least(v, len(seq)) for v in graph.last)
            graph.add(seq, r.randrange(1, 4))


def test_bins_over_tasks_and_batches(spark):
    """Bins of few bytes are dealt over tasks, and one may go on in the next batch; keys may be null."""
    r = random.Random(6)
    bins = {}
    for k in [(None, "x"), (None, None), (1, None)] + [(b, "y") for b in range(30)]:
        word = "".join(r.choice("ACGT") for _ in range(9))
        bins[k] = [word[:i] + r.choice("ACGT") + word[i + 1 :] for i in range(9) for _ in range(r.randrange(3))] + [word, word]
    rows = spark.createDataFrame([(*k, s) for k, segs in bins.items() for s in segs], "bin int, side string, seg string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, 3)
    try:
        got = bin_consensus(rows, ["bin", "side"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, kept)
    assert {(x.bin, x.side): x.seq for x in got} == {k: consensus([(s, segs.count(s)) for s in set(segs)]) for k, segs in bins.items()} and len(got) == len(bins)
    assert len({x.task for x in got}) > 1
