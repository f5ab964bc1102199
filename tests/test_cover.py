import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as I

SCHEMA = "grp long, s long, e long"


def random_spans(seed, n, size, longest):
    r = random.Random(seed)
    return [(g, a, a + r.randrange(longest)) for g in (1, 2) for a in (r.randrange(size) for _ in range(n))]


@pytest.mark.parametrize("tolerance", [0, 7])
def test_jumps_give_the_same_cover_as_the_fold(spark, monkeypatch, tolerance):
    rows = random_spans(1, 80, 400, 30) + [(1, 5, 5), (1, 5, 5), (3, 9, 12), (4, 0, 100), (4, 3, 50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    folded = sorted(map(tuple, I.minimal_cover(df, "grp", "s", "e", tolerance).collect()))
    monkeypatch.setattr(I, "LARGE", 0)
    assert sorted(map(tuple, I.minimal_cover(df, "grp", "s", "e", tolerance).collect())) == folded
    monkeypatch.setattr(I, "LARGE", 50)
    assert sorted(map(tuple, I.minimal_cover(df, "grp", "s", "e", tolerance).collect())) == folded


def test_a_million_intervals_in_one_group(spark):
    """One group, far above what a row may hold: a cover of every second interval, and no array of its intervals in the plan."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("grp"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 20).alias("e"))
    out = I.cover_by_jumps(df.select(F.col("grp").alias("g"), "s", "e"))
    plan = out._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    row = out.agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("e").alias("b"), F.sum(F.col("e") - F.col("s")).alias("len")).first()
    assert (row.a, row.b, row.n, row.len) == (0, (n - 1) * 10 + 20, n // 2 + 1, 20 * (n // 2 + 1))


def test_running_max(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), i, r.randrange(100)) for i in range(200)]
    got = {x.at: x.top for x in I.running_max(spark.createDataFrame(rows, "g int, at int, v int").repartition(6), ["at"], "v", "top").collect()}
    assert got == {i: max((v for h, j, v in rows if h == g and j < i), default=None) for g, i, _ in rows}
