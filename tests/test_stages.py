import os

import pytest
from pyspark.sql import functions as F

from strandloom.plans import splitter
from strandloom.plans.stages import Stages

from .test_plans import frame


def test_stages_are_made_once(spark, tmp_path):
    """A change of content, options or an earlier stage makes a stage anew and all that reads it; what is stale goes."""

    def run(rows, option=1):
        st = Stages(spark, f"file://{tmp_path}/run")
        df = spark.createDataFrame(rows, "a int, b string")
        one = st("one", lambda: df.withColumn("c", F.lit(option)), df, options=option)
        two = st("two", lambda: one.groupBy("c").agg(F.count("*").alias("n")), one)
        three = st("three", lambda: df.select("b").distinct(), df)
        return st.made, [tuple(r) for r in two.collect()], three.count()

    rows = [(1, "x"), (2, None), (None, "y"), (2, None)]
    assert run(rows) == (["one", "two", "three"], [(1, 4)], 3)
    assert run(rows[::-1]) == ([], [(1, 4)], 3)
    assert run(rows, 2) == (["one", "two"], [(2, 4)], 3)
    assert run(rows + [(2, None)], 2) == (["one", "two", "three"], [(2, 5)], 3)
    assert all(len(os.listdir(tmp_path / "run" / name)) == 1 for name in ("one", "two", "three"))
    Stages(spark, f"file://{tmp_path}/run").keep("three")
    assert os.listdir(tmp_path / "run") == ["three"]


def test_a_stage_cut_short_is_not_done(spark, tmp_path):
    st = Stages(spark, f"file://{tmp_path}")
    df = spark.range(3)
    bad = lambda: df.select(F.assert_true(F.col("id") < 2).isNull().alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        st("s", bad, df)
    assert st("s", lambda: df, df).count() == 3 and Stages(spark, f"file://{tmp_path}")("s", bad, df).count() == 3


def test_split_goes_on_behind_the_graph(spark, tmp_path, monkeypatch):
    """Stopped after the graph, a second run aligns nothing and builds no graph before it gets there again."""

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    unit = "".join("ACGT"[i * i % 7 % 4] + "ACGT"[(i * 5 + i // 3) % 4] for i in range(300))
    contigs, reads = frame(spark, [unit[:250], unit[200:420]], "C"), frame(spark, [unit[i : i + 120] for i in range(0, 300, 60)], "R")
    monkeypatch.setattr(splitter.G, "condense", stop)
    first, second = (Stages(spark, f"file://{tmp_path}/s") for _ in range(2))
    options = splitter.SplitOptions(runGraphSurgery=False, runBResolve=False, runXResolve=False)
    with pytest.raises(Stop):
        splitter.split(contigs, reads, options, stages=first)
    assert first.made == ["contigs", "reads", "contig_overlaps", "read_hits", "string_graph", "abundance", "contig_graph"]
    for name in ("aligned", "inherited", "surgery"):
        monkeypatch.setattr(splitter, name, lambda *_: pytest.fail("made again"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("again", "second run")
    try:
        with pytest.raises(Stop):
            splitter.split(contigs, reads, options, stages=second)
        assert second.made == [] and len(jobs.getJobIdsForGroup("again")) < 25
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    other = Stages(spark, f"file://{tmp_path}/s")
    with pytest.raises(Stop):
        splitter.split(contigs, reads, splitter.SplitOptions(runGraphSurgery=False, runBResolve=False, runXResolve=False, kthres=2), stages=other)
    assert other.made == ["contig_graph"]
