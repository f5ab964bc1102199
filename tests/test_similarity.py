import random

import numpy as np
import pytest

from strandloom.operators import similarity
from strandloom.operators.joins import align
from strandloom.operators.similarity import CODE, collinear, maximal_matches, minimizers, seed_size

TURN = str.maketrans("ACGT", "TGCA")


def plain_matches(refs, queries, k):
    """All pairs of places, extended letter by letter."""
    out = set()
    for ref, a in refs:
        for qry, text in queries:
            for strand, b in (("p", text), ("d", text[::-1].translate(TURN))):
                for i in range(len(a)):
                    for j in range(len(b)):
                        if i and j and a[i - 1] == b[j - 1] and a[i - 1] in "ACGT":
                            continue
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and a[i + n] in "ACGT":
                            n += 1
                        if n >= k:
                            out.add((ref, qry, strand, i, i + n, j, j + n))
    return out


def some_sequences(r, n, size, letters="ACGT"):
    return ["".join(r.choice(letters) for _ in range(r.randrange(size))) for _ in range(n)]


def tables(spark, refs, queries):
    return (spark.createDataFrame(x, "name string, seq string").repartition(2) for x in (refs, queries))


@pytest.mark.parametrize("often,known", [(64, 1 << 20), (0, 3)])
@pytest.mark.parametrize("k", [8, 20])
def test_matches_against_all_places(spark, monkeypatch, k, often, known):
    """Repeats, runs of one letter, other letters, short and empty sequences; the same when every seed is joined by whole windows, and when tasks don't know the refs' seeds."""
    monkeypatch.setattr(similarity, "OFTEN", often)
    monkeypatch.setattr(similarity, "KNOWN", known)
    monkeypatch.setattr(similarity, "PIECE", 64)
    r = random.Random(k)
    unit = "".join(r.choice("ACGT") for _ in range(60))
    refs = some_sequences(r, 4, 80) + [unit, unit[:30] + "N" + unit[30:], "A" * 40, "AC" * 25, "", unit[10:50] * 2]
    queries = some_sequences(r, 4, 80) + [unit[5:55], unit[::-1].translate(TURN), unit[:25] + "T" + unit[26:], "A" * 30 + "C", "CA" * 14, "N" * 30, "acgt", unit[:12]]
    refs, queries = [(f"r{i}", s) for i, s in enumerate(refs)], [(f"q{i}", s) for i, s in enumerate(queries)]
    a, b = tables(spark, refs, queries)
    rows = [tuple(x) for x in maximal_matches(a, b, k).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_matches(refs, queries, k)


def test_every_match_holds_a_common_seed():
    r = random.Random(2)
    for k in (8, 20, 31, 45):
        s, w = seed_size(k)
        part = "".join(r.choice("ACGT") for _ in range(k))
        kept = []
        for _ in range(2):
            text = "".join(r.choice("ACGT") for _ in range(70))
            text = text[:33] + part + text[33:]
            at, mer, *_ = minimizers(CODE[np.frombuffer(text.encode(), np.uint8)], s, w)
            kept.append({(p - 33, m) for p, m in zip(at.tolist(), mer.tolist(), strict=True) if 33 <= p <= 33 + k - s})
        assert kept[0] & kept[1]
    with pytest.raises(ValueError):
        seed_size(46)


def test_seeds_are_few():
    r = random.Random(1)
    x = CODE[np.frombuffer("".join(r.choice("ACGT") for _ in range(20_000)).encode(), np.uint8)]
    s, w = seed_size(24)
    assert len(minimizers(x, s, w)[0]) < 2.6 * len(x) / (w + 1)


def test_frequent_seeds_make_no_pairs_for_nothing(spark, monkeypatch):
    """A seed that is everywhere, always between other letters, gives no pair of seeds: the windows around it differ."""
    r = random.Random(5)
    core = "ACGTTGCATGCCA"
    texts = ["".join(r.choice("ACGT") for _ in range(12)) + core + "".join(r.choice("ACGT") for _ in range(12)) for _ in range(150)]
    refs, queries = [(f"r{i}", s) for i, s in enumerate(texts[:75])], [(f"q{i}", s) for i, s in enumerate(texts[75:])]
    monkeypatch.setattr(similarity, "OFTEN", 3)
    a, b = tables(spark, refs, queries)
    assert {tuple(x) for x in maximal_matches(a, b, 20).collect()} == plain_matches(refs, queries, 20)


def test_unique_anchors(spark):
    r = random.Random(3)
    one, two = ("".join(r.choice("ACGT") for _ in range(80)) for _ in range(2))
    a, b = tables(spark, [("r", one + "N" + two + "N" + two)], [("q", one + "N" + two)])
    every = {tuple(x) for x in maximal_matches(a, b, 20).collect()}
    only = {tuple(x) for x in maximal_matches(a, b, 20, unique=True).collect()}
    assert len(every) == 3 and only == {("r", "q", "p", 0, 80, 0, 80)}


def heaviest(matches):
    """Most letters of a chain, over all subsets."""
    best = 0
    for bits in range(1 << len(matches)):
        own = sorted(m for i, m in enumerate(matches) if bits >> i & 1)
        if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(own, own[1:], strict=False)):
            best = max(best, sum(m[2] for m in own))
    return best


def test_chains():
    r = random.Random(4)
    for _ in range(200):
        matches = [(r.randrange(12), r.randrange(12), r.randrange(1, 9)) for _ in range(r.randrange(1, 9))]
        label = collinear(*map(list, zip(*matches, strict=True)))
        for k in set(label):
            own = sorted(m for m, g in zip(matches, label, strict=True) if g == k)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(own, own[1:], strict=False))
        assert sum(m[2] for m, g in zip(matches, label, strict=True) if g == 0) == heaviest(matches)


def test_crossing_matches_are_two_rows(spark):
    """Two stretches that change places within the gap are no chain, which windows over gaps can't tell."""
    r = random.Random(6)
    x, y = ("".join(r.choice("ACGT") for _ in range(50)) for _ in range(2))
    a, b = tables(spark, [("r", x + y)], [("q", y + x)])
    got = {(m.s1, m.e1, m.s2, m.e2, m.idy) for m in align(a, b, 20, gap=200, drift=300).collect()}
    assert got == {(1, 50, 51, 100, 100.0), (51, 100, 1, 50, 100.0)}
    c, d = tables(spark, [("r", x + y)], [("q", x + "A" * 3 + y)])
    rows = align(c, d, 20).collect()
    assert len(rows) == 1 and (rows[0].s1, rows[0].e1, rows[0].s2, rows[0].e2) == (1, 100, 1, 103)


def test_letters_outside_bases_count_as_one_place(spark):
    a, b = tables(spark, [("r", "é中" + "ACGTTGCAAGGCTTAACCGT" * 2)], [("q", "中" + "ACGTTGCAAGGCTTAACCGT" * 2 + "é")])
    row = align(a, b, 20, least=40).orderBy("s1", "s2").where("len1 = 40").first()
    assert (row.s1, row.e1, row.s2, row.e2) == (3, 42, 2, 41)


def test_empty(spark):
    a, b = tables(spark, [("r", None), ("s", "ACGT")], [("q", "")])
    assert maximal_matches(a, b).count() == 0 and align(a, b).count() == 0


def test_edit_distances_of_many_pairs():
    """Pairs taken together have the distance each has alone; longer ones are taken one by one."""
    import random

    from strandloom.functions.alignment import edit_distance, edit_distances

    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(9)))
    a, b = [word() for _ in range(300)] + ["x" * 150, ""], [word() for _ in range(300)] + ["xy" * 70, ""]
    assert edit_distances(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert edit_distances([], []).tolist() == [] and edit_distances(["é"], ["e"]).tolist() == [1]


def test_pairs_of_few_groups_are_made_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from strandloom.functions import sequence as S
    from strandloom.operators import joins as J

    left = spark.range(400).select((F.col("id") % 2).alias("g"), "id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("x"))
    right = spark.range(30).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("y"))
    got = J.dealt_pairs(left.coalesce(1), right.coalesce(1), "g", "id")
    plain = left.join(right, "g")
    d = [c for c in (S.hamming_prefix("x", "y"), F.levenshtein("x", "y"))]
    assert sorted(map(tuple, got.select("id", "k", *d).collect())) == sorted(map(tuple, plain.select("id", "k", *d).collect()))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert [r[0] for r in spark.createDataFrame([("", "abc"), ("abd", "abcd"), (None, "a")], "x string, y string").select(S.hamming_prefix("x", "y")).collect()][:2] == [0, 1]


def test_containment_joins_on_both_equations(spark):
    """As one equation over both sides, the second is judged on all pairs of a nation."""
    from strandloom import queries as Q

    t = lambda sql: Q.rel(spark, "/root/testdata/sf0.001", sql)
    got, want = Q.contained(t), t(Q.CONTAINED)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes
    keys = [x.split("]")[0] for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.startswith("Join") or "Join Inner" in x]
    assert any("k#" in x and "n#" in x for x in keys)


@pytest.mark.parametrize("states", [1, 1 << 26])
def test_distances_of_many_strings(monkeypatch, states):
    """Strings of no letter to several words of bits, of letters of one to four bytes, beside one another."""
    import random

    from strandloom.functions import distances as D

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    monkeypatch.setattr(D, "STATES", states)
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab€😀") for _ in range(n))
    short = ["", *(word(r.randrange(20)) for _ in range(12)), word(31), word(32)]
    texts = ["", short[3], *(word(r.randrange(90)) for _ in range(8))]
    for patterns in (short, [*short, word(33)], [*short, *(word(n) for n in (63, 64, 65, 128, 129))]):
        assert D.edits(patterns, texts).tolist() == [[plain(p, t) for p in patterns] for t in texts]
        assert D.differing(patterns, texts).tolist() == [[sum(x != y for x, y in zip(p, t, strict=False)) for p in patterns] for t in texts]
    assert D.edits([], ["a"]).shape == (1, 0) and D.differing(["a"], []).shape == (0, 1)


def test_pair_distances_are_dealt_by_cells(spark, monkeypatch):
    """All pairs of a group, null strings and keys included, from cells of bounded size; a call sees no more, whatever a group holds, and no distance is taken pair by pair."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from strandloom.functions import distances as D
    from strandloom.functions import sequence as S
    from strandloom.operators import joins as J

    monkeypatch.setattr(J, "CELL", (64, 16))
    left = spark.createDataFrame([(None if i % 50 == 0 else i % 3, None if i % 41 == 0 else i, None if i % 17 == 0 else "ab€"[: i % 4] + str(i * i)) for i in range(400)], "g int, id long, x string")
    right = spark.createDataFrame([(i % 4, i, None if i % 13 == 0 else "a" * (i % 3) + str(i)) for i in range(90)], "g int, k int, y string")
    plain = left.join(right, "g")
    for f, want in ((D.edits, F.levenshtein("x", "y")), (D.differing, F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), S.hamming_prefix("x", "y")))):
        got = J.pair_distances(left.coalesce(1), right.coalesce(1), "g", f)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.select("id", "k", want).collect()), key=str)
        assert got.dtypes == [("id", "bigint"), ("k", "int"), ("d", "int")]
    seen = spark.sparkContext.accumulator(0)

    def small(a, b):
        seen.add(1)
        assert len(a) <= 150 and len(b) <= 50
        return D.edits(a, b)

    assert J.pair_distances(left, right, "g", small).count() == plain.count() and seen.value >= 12
    assert J.pair_distances(left.limit(0), right, "g", D.edits).count() == 0
    for name, slow in (("levenshtein_pairs", "levenshtein("), ("hamming_prefix", "zip_with")):
        plan = entry.queries()[name](spark, entry.DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert slow not in plan and "FlatMapCoGroupsInArrow" in plan
