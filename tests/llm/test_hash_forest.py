import math

import numpy as np
import pytest

from strandloom.llm import hash_forest
from strandloom.llm.hash_forest import nearest

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, every=20, k=20):
    good = [(i, [float(y) for y in v]) for i, v in rows if i is not None and v and all(y is not None and math.isfinite(y) for y in v) and any(v)]
    out = set()
    for i, q in {(i, tuple(q)) for i, q in good if i % every == 0}:
        near = set()
        for j, v in good:
            if j != i and len(v) == len(q):
                s = 0.0
                for a, b in zip(q, v, strict=True):
                    s += a * b
                near.add((-s, j))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:k])}
    return out


def result(spark, rows, **more):
    got = nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()
    return {tuple(r)[:4] for r in got}, {r.recall for r in got}, len(got)


def clusters(n, groups, spread=0.05, dim=16, seed=1, scale=False):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    x = centre[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))
    if scale:
        x *= np.exp(r.normal(size=(n, 1)))
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.fixture
def small(monkeypatch):
    """Many leaves, splits by further letters, blocks of equal strings, and parts of queries, on a small table."""
    for name, value in {"LEAF": 4, "LIMIT": 40, "QUERIES_AT_ONCE": 8, "HOT": 30}.items():
        monkeypatch.setattr(hash_forest, name, value)


def test_search_of_clusters_is_partial_and_good(spark, small, monkeypatch):
    """Clustered vectors are found without looking at all of them: recall against brute force, and true scores."""
    seen = []
    ascents = hash_forest.ascents
    monkeypatch.setattr(hash_forest, "ascents", lambda steps, totals, quota: (seen.append(quota), ascents(steps, totals, quota))[1])
    rows = clusters(3000, 100)
    got, recall, n = result(spark, rows)
    want = plain(rows)
    assert seen[-1] is not None and n == len(got) == len(want)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    (told,) = recall
    assert told >= 0.9
    x = dict(rows)
    for q, _, v, s in list(got)[:500]:
        total = 0.0
        for a, b in zip(x[q], x[v], strict=True):
            total += a * b
        assert s == total


def test_lengths_of_all_sizes(spark, small):
    """Long vectors are everyone's neighbours: what the forest can't tell apart is searched whole."""
    rows = clusters(800, 30, scale=True)
    got, (told,), n = result(spark, rows)
    want = plain(rows)
    assert told >= 0.9 and n == len(want) and len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * n


def test_no_structure_is_searched_whole(spark, small):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(700, 24)).tolist())]
    got, recall, _ = result(spark, rows)
    assert got == plain(rows) and recall == {1.0}


def test_hot_vector_and_near_copies(spark, small):
    """A third of rows equal, a third nearly equal (one hash string for most of them): nothing is lost, ties go to smaller ids."""
    base = np.random.default_rng(3).normal(size=8)
    rows = [(i, (base if i % 3 == 0 else base + 1e-9 * i if i % 3 == 1 else np.random.default_rng(i).normal(size=8)).tolist()) for i in range(600)]
    got, recall, _ = result(spark, rows)
    assert recall <= {1.0} and got == plain(rows)


HARD = [
    (0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [9.0, 9.0]),
    (20, [1.0, 2.0, 3.0]), (21, [3.0, 2.0, 1.0]), (40, [5.0]), (60, [1.0, 1.0]), (60, [2.0, 1.0]), (60, [2.0, 1.0]), (8, [-1.0, -0.0]), (-20, [1.0, 0.0]), (9, [1e-300, 1e-300]), (80, [0.0, 0.0]),
]


@pytest.mark.parametrize("rows", [HARD, HARD * 2, [], [(1, [1.0])], [(20, [1.0])], [(20, None), (21, [1.0])]])
def test_hard_rows(spark, rows):
    got, recall, _ = result(spark, rows)
    assert got == plain(rows)
    assert recall <= {1.0}


def test_other_numbers_and_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(90)]
    got, _, n = result(spark, rows, every=9, k=3)
    assert got == plain(rows, 9, 3) and n == len(got)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id `my id`", "cast(embedding as array<float>) v", "1 node", "2 q", "vec_id id")
    assert {tuple(r)[:4] for r in nearest(df, 9, 3, "my id", "v").collect()} == got


def test_letters_shared():
    """Codes of a vector and of its copy as a query agree where norms are equal."""
    x = np.random.default_rng(4).normal(size=(50, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    longest, normal, offset = hash_forest.planes(x, np.ones(50), 1.0)
    assert normal.shape == (hash_forest.TREES * hash_forest.BITS, 7) and longest == 1.0
    side = hash_forest.extended(x, np.ones(50), 1.0) @ normal.T > offset
    assert abs(side.mean() - 0.5) < 0.05


def test_leaves_below_a_prefix_are_a_range(spark):
    """The table of prefixes has each one once, whatever the number of leaves below it, and names those as a range of numbers."""
    leaves = [(1, 0, 3, p, 10 + p, 1 + p % 3) for p in range(48)] + [(1, 0, 1, 3, 5, 1)]
    tree = hash_forest.numbered(spark.createDataFrame(leaves, "width int, tree int, length int, prefix long, n long, blocks int")).collect()
    got = hash_forest.levels(spark.createDataFrame(tree)).collect()
    assert len(got) == 1 + 4 + 12 + 48
    for x in got:
        below = [t for t in tree if t.length >= x.level and t.prefix >> 2 * (t.length - x.level) == x.at]
        assert x.n == sum(t.n for t in below)
        assert sorted(k for t in below for k in range(t.first, t.first + t.blocks)) == list(range(x.first, x.last + 1))


def test_no_growing_table_is_broadcast(spark, small, monkeypatch):
    """Only the totals of widths, a row each, and the results of hot classes go through the driver: every other join merges, however small its files are."""
    plans, keep = [], hash_forest.materialised

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *more)

    monkeypatch.setattr(hash_forest, "materialised", seen)
    out = nearest(spark.createDataFrame(clusters(600, 30), SCHEMA))
    rounds = sum("BroadcastHashJoin" in p for p in plans)
    assert rounds == sum("total" in p and "SortMergeJoin" in p and "BroadcastHashJoin" in p for p in plans) and sum(p.count("BroadcastHashJoin") for p in plans) == rounds
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
