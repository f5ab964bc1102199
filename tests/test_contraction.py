"""Strongly connected components, cycles and contracted reads against plain searches."""

import random

import pytest

from strandloom.operators import contraction as K
from strandloom.operators import graph as G
from strandloom.operators import resolve as R
from strandloom.plans.runtime import materialised

EDGES = "src long, dst long"


def closure(edges, passes=lambda x: True):
    """Pairs (a, b) with a way from a to b whose inner nodes pass."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        front = list(out[a])
        while front:
            b = front.pop()
            if (a, b) not in found:
                found.add((a, b))
                if passes(b):
                    front.extend(out.get(b, ()))
    return found


def some_edges(seed, nodes, n, back):
    """Edges mostly forward, a share of them back, loops and repeats among them."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = r.randrange(nodes), r.randrange(nodes)
        a, b = min(a, b), max(a, b)
        rows.append((b, a) if r.random() < back else (a, b))
    return rows + rows[:3]


@pytest.mark.parametrize("local, seed, back", [(10_000, 1, 0.0), (10_000, 2, 0.1), (10_000, 3, 0.5), (20, 2, 0.1), (20, 3, 0.5)])
def test_strong_components(spark, local, seed, back):
    edges = some_edges(seed, 60, 90, back)
    ways = closure(edges)
    want = {x: min([x] + [y for y in range(60) if (x, y) in ways and (y, x) in ways]) for e in edges for x in e}
    got = {r.id: r.component for r in K.strong_components(spark.createDataFrame(edges, EDGES), local).collect()}
    assert got == want


@pytest.mark.parametrize("local", [20, 10_000])
def test_cycles(spark, local):
    edges = some_edges(7, 40, 70, 0.25) + [(90, 90), (100, 101), (101, 102), (102, 103), (103, 100)]
    ways = closure(edges)
    got = {}
    for r in K.cycles(spark.createDataFrame(edges, EDGES), local=local).collect():
        got.setdefault(r.component, {})[r.pos] = r.id
    roots = {min(y for y in {x for e in edges for x in e} if (x, y) in ways and (y, x) in ways) for x, y in ways if x == y}
    assert set(got) == roots and got[90] == {0: 90} and got[100] == {k: 100 + k for k in range(4)}
    for root, way in got.items():
        nodes = [way[k] for k in range(len(way))]
        assert nodes[0] == root and len(set(nodes)) == len(nodes)
        assert all(e in edges for e in zip(nodes, nodes[1:] + nodes[:1], strict=True))
        near, dist = {root}, 0  # breadth first: no shorter way back
        while not any((x, root) in edges for x in near):
            near, dist = {b for a, b in edges if a in near}, dist + 1
        assert len(nodes) == dist + 1


def test_many_small_rings_take_few_jobs(spark):
    """3,000 rings of four, each linked to one more node, beyond what one task searches: split by what hangs together, not label by label."""
    edges = [(10 * k + i, 10 * k + (i + 1) % 4) for k in range(3000) for i in range(4)] + [(10 * k, 10 * k + 5) for k in range(3000)]
    rows = spark.createDataFrame(edges, EDGES)
    labels = []
    real = K._least_ahead
    K._least_ahead = lambda *a: labels.append(1) or real(*a)
    try:
        got = {r.id: r.component for r in K.strong_components(rows, 1000).collect()}
    finally:
        K._least_ahead = real
    assert got == {x: x - x % 10 if x % 10 < 4 else x for e in edges for x in e} and not labels


def test_empty(spark):
    none = spark.createDataFrame([], EDGES)
    assert K.strong_components(none).count() == 0 and K.cycles(none).count() == 0
    assert K.reach(none, 10).count() == 0


@pytest.mark.parametrize("seed, back", [(2, 0.1), (3, 0.5)])
def test_contracted_reach_is_that_of_all_reads(spark, seed, back):
    """Contigs 0 to 9 among reads: pairs, labels and sole contigs as searches over all reads give them."""
    edges = some_edges(seed, 60, 80, back)
    ways = closure(edges, lambda x: x >= 10)
    rows = spark.createDataFrame(edges, EDGES)
    assert {tuple(r) for r in K.reach(rows, 10, steps=1).collect()} == {(a, b) for a, b in ways if a < 10 and b < 10 and a != b}
    repeats = spark.createDataFrame([(0, [0, 1, 2, 3], [6, 7, 8, 9])], "rep_id long, ins array<long>, outs array<long>")
    want = {}
    for x in range(10, 60):
        a, b = [k for k in range(4) if (k, x) in ways], [k for k in range(6, 10) if (x, k) in ways]
        if a or b:
            want[x] = (a or None, b or None)
    assert {r.id: (r.from_ins, r.to_outs) for r in R.reach_labels(rows, repeats, 10).collect()} == want
    leads = {x: {b for a, b in ways if a == x and b < 10} for x in range(10, 60)}
    assert {(r.read, r.contig) for r in R.sole_contig(rows, 10).collect()} == {(x, min(v)) for x, v in leads.items() if len(v) == 1}


def test_long_rows_of_reads_take_few_jobs(spark, ahead=3):
    """2,000 reads in a row, each overlapping so many behind it, between contigs 0 and 2: in a search by steps a job for each read."""
    way = [0, *range(10, 2010), 2]
    edges = [(way[i], way[i + k]) for i in range(len(way)) for k in range(1, ahead + 1) if i + k < len(way) and (k == 1 or 0 < i and i + k < len(way) - 1)]
    rows = spark.createDataFrame(edges, EDGES).coalesce(1)
    writes = []
    real = K.materialised

    def counted(df, replaces=None):
        writes.append(1)
        return real(df, replaces)

    for m in (K, G, R):
        m.materialised = counted
    try:
        got = [tuple(r) for r in K.reach(rows, 10, steps=1).collect()]
    finally:
        for m in (K, G, R):
            m.materialised = real
    assert got == [(0, 2)] and len(writes) <= 30


def test_separate_paths_are_the_first_of_all_pairs(spark):
    """All sets of up to six paths of a small repeat, and some larger ones."""
    r = random.Random(5)
    rows = [(k, r.randrange(1 + k % 4), r.randrange(1 + k % 3)) for k in range(300) for _ in range(1 + k % 6)]
    want = {}
    for k in range(300):
        own = {(a, b) for i, a, b in rows if i == k}
        both = sorted((a, b, x, y) for a, b in own for x, y in own if a < x and b != y)
        if both:
            want[k] = both[0]
    got = R.separate_paths(spark.createDataFrame(rows, "rep_id long, l long, r long")).collect()
    assert {x.rep_id: tuple(x)[1:] for x in got} == want and len(want) > 50


def test_contraction_sends_no_table_to_the_driver(spark, monkeypatch):
    """No round of the contraction plans a broadcast of a table that grows with the reads, however small it is here."""
    plans = []

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialised(df, *args)

    for module in (K, G, R):
        monkeypatch.setattr(module, "materialised", seen)
    rows = spark.createDataFrame([(100 + i, 101 + i) for i in range(20)] + [(120, 3), (300, 100), (300, 5), (100, 102)], EDGES)
    assert {tuple(x) for x in R.sole_contig(rows, 10).collect()} == {(100 + i, 3) for i in range(21)}
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_without_edges_between_reads_nothing_is_contracted(spark, monkeypatch):
    """Reads that hang on contigs only: labels and sole contigs come from the edges as they are, without a round."""
    for name in ("contracted", "shortest_paths"):
        monkeypatch.setattr(R, name, None)
    rows = spark.createDataFrame([(0, 100), (0, 100), (2, 100), (100, 4), (0, 101), (101, 6), (101, 4), (102, 6), (4, 103)], EDGES)
    repeats = spark.createDataFrame([(0, [0, 2], [4, 6])], "rep_id long, ins array<long>, outs array<long>")
    assert {r.id: (r.from_ins, r.to_outs) for r in R.reach_labels(rows, repeats, 10).collect()} == {100: ([0, 2], [4]), 101: ([0], [4, 6]), 102: (None, [6])}
    assert {tuple(x) for x in R.sole_contig(rows, 10).collect()} == {(100, 4), (102, 6)}
