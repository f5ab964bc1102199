"""Literal cases of the break model."""

import pytest

from strandloom.operators import breaks as B
from strandloom.schemas import BREAKPOINT

ALN = "s1 int, e1 int, s2 int, e2 int, ref string, qry string, rep long"
# Literal cases of the break model, here and in the tables of choices and clusters below.
FIRST = (1001, 2001, 1001, 2001, "Contig1", "Contig2", 0)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("aln", "want"),
    [
        ([FIRST], [("Contig1", 2001, 2016), ("Contig2", 2001, 2016)]),
        ([(1001, 2001, 2001, 1001, "Contig1", "Contig2", 0)], [("Contig1", 2001, 2016), ("Contig2", 1001, 1016)]),
        ([FIRST, (1501, 2501, 1501, 2501, "Contig2", "Contig3", 1)], [("Contig1", 1501, 1516), ("Contig2", 1501, 1516), ("Contig3", 1501, 1516)]),
        ([FIRST, (1501, 2501, 2501, 1501, "Contig2", "Contig3", 1)], [("Contig1", 1501, 1516), ("Contig2", 1501, 1516), ("Contig3", 2501, 2516)]),
    ],
)
def test_break_intervals(spark, aln, want):
    assert rows(B.break_intervals(spark.createDataFrame(aln, ALN))) == want


def test_natural(spark):
    got = rows(B.natural(spark.createDataFrame([FIRST], ALN)))
    assert got == [(0, 0, 0, 0, "Contig1", 1001), (1, 0, 1, 1, "Contig1", 2001), (2, 0, 2, 0, "Contig2", 1001), (3, 0, 3, 1, "Contig2", 2001)]
    got = rows(B.natural(spark.createDataFrame([(1001, 2001, 2001, 1001, "Contig1", "Contig2", 0)], ALN)))
    assert got == [(0, 0, 0, 0, "Contig1", 1001), (1, 0, 1, 1, "Contig1", 2001), (2, 0, 3, 0, "Contig2", 2001), (3, 0, 2, 1, "Contig2", 1001)]


def test_single_repeat_has_nothing_hidden(spark):
    points = B.natural(spark.createDataFrame([FIRST], ALN))
    assert rows(B.with_hidden(points)) == rows(points)


def test_hidden_points_of_a_chain(spark):
    points = B.natural(spark.createDataFrame([FIRST, (1501, 2501, 1501, 2501, "Contig2", "Contig3", 1)], ALN))
    new = {tuple(r)[1:] for r in B.with_hidden(points).collect()} - {tuple(r)[1:] for r in points.collect()}
    assert new == {(1, -2, 2, "Contig1", 1501), (0, -5, 1, "Contig3", 2001)}


SEQS = "key long, rep long, endpt int, cluster long, contig string, loc int"


def as_points(spark, seqs, codes):
    data = [(k, 0, codes[k][1], codes[k][0], f"Contig{i}", 1000 * j) for i, s in enumerate(seqs) for j, k in enumerate(s)]
    return spark.createDataFrame(data, BREAKPOINT)


@pytest.mark.parametrize(
    ("seqs", "codes", "want"),
    [
        ([[1, 2], [3, 4]], {1: (1, 0), 2: (2, 1), 3: (1, 2), 4: (2, 3)}, [[[1, 3], [2, 4]]]),
        ([[1, 2, 3], [4, 5, 6, 7], [8, 9, 10]], {1: (1, 0), 2: (2, -2), 3: (3, 1), 4: (1, 2), 5: (2, 0), 6: (3, 3), 7: (4, 1), 8: (2, 2), 9: (3, -5), 10: (4, 3)}, [[[2, 5, 8], [3, 6, 9]]]),
        ([[1, 2], [3, 4]], {1: (1, 0), 2: (2, 1), 3: (2, 2), 4: (1, 3)}, [[[1, 4], [2, 3]]]),
        ([[1, 2, 3, 4], [5, 6, 7, 8]], {1: (1, 0), 2: (2, 1), 3: (3, 0), 4: (4, 1), 5: (1, 2), 6: (2, 3), 7: (3, 2), 8: (4, 3)}, [[[1, 5], [2, 6]], [[3, 7], [4, 8]]]),
    ],
)
def test_choices(spark, seqs, codes, want):
    got: dict = {}
    for choice, option, keys in B.choices(as_points(spark, seqs, codes)).collect():
        got.setdefault(choice, [None, None])[option] = list(keys)
    assert sorted(got.values()) == want


def test_cuts(spark):
    options = [(0, 0, [11]), (0, 1, [12]), (1, 0, [1, 2, 3]), (1, 1, [4, 5, 6]), (2, 0, [4, 5]), (2, 1, [9, 10])]
    got = B.cuts(spark.createDataFrame(options, "choice_id long, option int, keys array<long>"))
    assert {r.key for r in got.collect()} == {4, 5, 6, 12}


def test_clusters_merge_and_neighbours_go(spark):
    points = [(0, 0, 0, 0, "Contig1", 1000), (1, 0, 1, 1, "Contig1", 2000), (2, 1, 3, 4, "Contig1", 2030), (3, 1, 2, 5, "Contig1", 2050), (4, 2, 1, 4, "Contig2", 10)]
    got = rows(B.clustered(spark.createDataFrame(points, BREAKPOINT)))
    assert [(k[0], k[3]) for k in got] == [(0, 0), (1, 1), (3, 5), (4, 1)]


def test_count_grouping():
    from strandloom.functions.stats import group_count_test, grouping

    assert grouping([10, 20, 21, 19, 20, 26], [1] * 6, [1, 0, 0, 0, 1]) == [(10, 1), (80, 4), (26, 1)]
    marks = group_count_test([2000, 2010, 5000, 5010], [100] * 4)
    assert marks == [0, 1, 0]


def test_binomial():
    from math import comb

    from strandloom.functions.stats import binomial_p

    assert round(binomial_p(10, 30, 0.5), 10) == 0.0987371467
    pmf = [comb(12, k) * 0.3**k * 0.7 ** (12 - k) for k in range(13)]
    assert abs(binomial_p(2, 12, 0.3) - sum(p for p in pmf if p <= pmf[2] * (1 + 1e-7))) < 1e-12
    assert binomial_p(5, 1_000_000, 1e-5) > 0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], ALN)
    assert rows(B.break_intervals(empty)) == []


def _random_repeats(n, seed, contigs=3):
    import random

    r = random.Random(seed)
    out = []
    for k in range(n):
        a, b, size, turned = r.randrange(1, 900), r.randrange(1, 900), r.randrange(1, 300), r.random() < 0.4
        out.append((a, a + size, b + size if turned else b, b if turned else b + size, f"C{r.randrange(contigs)}", f"C{r.randrange(contigs)}", k))
    return out


@pytest.mark.parametrize(("n", "apart", "width"), [(12, 20, 64), (12, 5, 1000), (40, 5, 16), (2, 0, 100)])
def test_projected_points_against_pairs(spark, n, apart, width):
    """Points shown on the other copy, counted out over all pairs of a copy and a point, copies of one contig and turned ones included."""
    points = B.natural(spark.createDataFrame(_random_repeats(n, n + apart), ALN))
    table = [tuple(r) for r in points.collect()]
    copy = {}
    for r in B.copies(points).collect():
        copy[r.rep, r.copy] = r
    want = set()
    for (rep, side), x in copy.items():
        y = copy[rep, 1 - side]
        within = lambda p, z: p[4] == z.contig and z.lo <= p[5] <= z.hi
        has = {(p[1], p[3]) for p in table if within(p, y)}
        seen = [((x.hi - p[5] if x.turned else p[5] - x.lo) + y.lo, p[1], -2 - p[2], p[3]) for p in table if within(p, x) and (p[1], p[3]) not in has]
        last = y.lo
        for loc, r, e, k in sorted(seen):
            if abs(loc - last) >= apart and abs(y.hi - loc) >= apart:
                want.add((r, e, k, y.contig, loc))
            last = loc
    assert {tuple(r) for r in B.projected(points, apart, width).collect()} == want
    assert want or n == 2


def test_hidden_points_keep_no_pairs(spark, monkeypatch):
    """600 repeats over one another: some 300,000 pairs of a copy and a point, of which none is written."""
    sizes, keep = [], B.materialised

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "materialised", counted)
    points = B.natural(spark.createDataFrame(_random_repeats(600, 1, 2), ALN))
    assert B.enclosed(points).count() > 100_000
    B.with_hidden(points, 5).count()
    assert max(sizes) <= 4 * 2400


@pytest.mark.parametrize("width", [7, 10_000])
def test_enclosed_totals(spark, width):
    from pyspark.sql import functions as F

    points = B.natural(spark.createDataFrame(_random_repeats(40, 3), ALN))
    want = B.enclosed(points, 100).groupBy("in_rep", "copy").agg(F.count("*").alias("n"), F.sum(F.col("key") % 11).alias("s"))
    got = B.enclosed_totals(points, F.col("key") % 11, width)
    assert rows(got) == rows(want)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString() and "hi" not in got.columns


def _plain_totals(aln, value):
    """in_rep, copy, n, s by looking at all pairs; None stands for null, as SQL has it."""
    points = [(r, side, contig, loc, None if r is None else r * 4 + 2 * side + k) for r, ref, qry, *x in aln for side, contig in enumerate((ref, qry)) for k, loc in enumerate(x[2 * side : 2 * side + 2])]
    both, out = {}, {}
    for r, side, contig, loc, _ in points:
        if loc is not None and contig is not None:
            both.setdefault((r, side, contig), []).append(loc)
    for (r, side, contig), at in both.items():
        here = [k for _, _, x, loc, k in points if x == contig and loc is not None and min(at) <= loc <= max(at)]
        n, known = out.setdefault((r, side), ([], []))
        n += here
        known += [value(k) for k in here if k is not None]
    return sorted(((*k, len(n), sum(known) if known else None) for k, (n, known) in out.items()), key=str)


@pytest.mark.parametrize("rows_at_once", [1, 1 << 18])
@pytest.mark.parametrize("width", [1, 10_000])
def test_totals_of_odd_copies(spark, monkeypatch, width, rows_at_once):
    """Rows that share a rep, on one contig or on several, copies over many bins, negative places, nulls, and a rep that is null."""
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(B, "ROWS_AT_ONCE", rows_at_once)
    draw = random.Random(5)
    aln = [(draw.randrange(40), draw.choice("AB"), draw.choice("BCD"), *(draw.randrange(-300, 300) for _ in range(4))) for _ in range(120)]
    aln += [(None, "N", "A", 5, 9, -20, 20), (None, "N", "E", 7, 12, 1, 2), (50, None, "A", 1, 2, None, 4), (51, "A", "B", None, None, 3, 3)] + aln[:3]
    df = spark.createDataFrame(aln, "rep long, ref string, qry string, s1 int, e1 int, s2 int, e2 int").repartition(3)
    want = _plain_totals(aln, lambda k: k % 11)
    assert any(r is None and s is None for r, _, _, s in want)
    assert sorted(map(tuple, B.enclosed_totals_of(df, lambda key: key % 11, width).collect()), key=str) == want
    assert sorted(map(tuple, B.enclosed_totals(B.natural(df), F.col("key") % 11, width).collect()), key=str) == want


def test_alignments_are_sent_before_their_points(spark):
    """Of the query's rows an alignment goes through the first exchange as one row, not as four points and the ends of two copies."""
    import __spark_entry__ as entry

    plan = entry.queries()["enclosed_points"](spark, entry.DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("Generate") and "Join" not in plan
