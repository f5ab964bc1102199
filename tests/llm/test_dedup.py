import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import anchors, embedding_dedup, minhash_dedup, recompression
from strandloom.llm.common import mix
from strandloom.llm.minhash_dedup import near_duplicates, representatives
from strandloom.llm.recompression import remove_shared
from strandloom.llm.suffix_dedup import remove_repeats

from . import brute

SCHEMA = "doc_id long, text string, kept string, rest string"


def texts(seed, n=40):
    """Texts with shared passages, near copies, runs, periods, ties, nulls and empty ones."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    passages = [say(r.randint(30, 90)) for _ in range(4)]
    out = []
    for _ in range(n):
        w = say(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "edit"
            at = r.randint(0, len(w))
            w[at:at] = p
        if r.random() < 0.2:
            w += ["run"] * r.randint(1, 80)
        if r.random() < 0.2:
            w += ["Is", "onhe."] * r.randint(1, 60)
        out.append(r.choice([" ", "  ", "\n"]).join(w))
    out += [out[0], out[0], out[1] + " tail", "", None, " \n ", "one", "a b c"]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("parts", ["4", "64"])
@pytest.mark.parametrize("seed", [1, 2])
def test_shared_words(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(anchors, "SPLIT_SAMPLE", 1.0)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = list(enumerate(texts(seed)))
    got = remove_shared(frame(spark, rows), window=50)
    assert got.columns[:3] == ["doc_id", "text", "rest"]
    from pyspark.sql import functions as F

    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got.collect())) == brute.shared_words(rows, 50)


@pytest.mark.parametrize("parts", ["4", "64"])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(anchors, "SPLIT_SAMPLE", 1.0)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = list(enumerate(texts(seed)))
    from pyspark.sql import functions as F

    got = remove_repeats(frame(spark, rows), window=200).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    got = sorted(map(tuple, got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute.repeated_bytes(rows, 200)


def test_rows_with_one_id_and_null_ids(spark):
    t = texts(5, 6)
    rows = [(7, t[0]), (7, t[0]), (7, t[1]), (None, t[0]), (None, t[2]), (3, t[1]), (3, None)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in remove_shared(frame(spark, rows)).collect()))
    want = sorted((i is None, i or 0, n, k) for i, n, k, _ in brute.shared_words(rows, 50))
    assert got == want
    got = sorted((r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == sorted((n, k) for _, n, k, _, _ in brute.repeated_bytes(rows, 200))
    out = near_duplicates(frame(spark, rows), 4)
    assert out.count() == len(rows)
    assert representatives(frame(spark, rows), 4).count() == len({brute.shingles(x, 4) for _, x in rows if x}) + 1


def test_cut_characters_go(spark):
    half = "é" * 150
    got = remove_repeats(frame(spark, [(1, "a" + half), (2, "bb" + half)]), as_text=True).collect()
    assert {r.kept for r in got} == {"a", "bb"}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert remove_shared(none).count() == remove_repeats(none).count() == near_duplicates(none).count() == representatives(none).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    kind = __import__("strandloom.llm.suffix_dedup", fromlist=["x"])
    import pyarrow as pa

    monkeypatch.setattr(kind, "PIECE", 500)
    windows = {}
    for _, l1, l2, mark, lo, hi in kind.byte_kind(200).records(pa.array([base])):
        for a, b in zip(lo, hi, strict=True):
            windows.update({k: 1 for k in range(a, b + 1)})
    assert sorted(windows) == list(range(len(base) - 199))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=50, max_size=90), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["ab", "abcd"]))
def test_symbols_of_a_window_depend_on_it_only(middle, left, right, letters):
    """A window's high-level symbol is the same in any text."""
    r = random.Random(left * 100 + right)
    code = lambda w: mix(np.array([ord(x) for x in w], np.uint64))
    found = []
    for a, b in ((left, right), (right, left)):
        x = code([r.choice(letters) for _ in range(a)] + middle + [r.choice(letters) for _ in range(b)])
        start = np.arange(a, a + len(middle) - 49)
        name, at, size = recompression.high_symbols(x, np.array([0, len(x)]), start, 50)
        assert (at >= start).all() and (at + size <= start + 50).all()
        found.append((name.tolist(), (at - start).tolist(), size.tolist()))
    assert found[0] == found[1]


def test_symbols_grow_and_rows_end_them():
    """Symbols of many words come up, and none spans two rows."""
    r = random.Random(3)
    x = mix(np.array([r.randrange(10**6) for _ in range(4000)], np.uint64))
    first = np.array([0, 1000, 1000, 1060, 4000])
    start = np.array([i for a, b in zip(first[:-1], first[1:], strict=True) for i in range(a, b - 49)])
    _, at, size = recompression.high_symbols(x, first, start, 50)
    assert size.max() > 16 and size.mean() > recompression.LONG
    row = np.searchsorted(first, at, "right")
    assert (row == np.searchsorted(first, at + size - 1, "right")).all()


def test_patterned_words_are_told_apart(spark):
    """Words and sequences made of two letters in the order of Thue and Morse, and its complement, are different ones."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    base = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*base, word])), (2, " ".join([*base, other])), (3, " ".join("xy"[c == "a"] for c in word)), (4, " ".join("xy"[c == "a"] for c in other)), (5, word), (6, other), (7, word[:1024]), (8, other[:1024])]
    from pyspark.sql import functions as F

    got = remove_shared(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256)).collect()
    assert sorted(map(tuple, got)) == brute.shared_words(rows, 50)
    got = remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute.repeated_bytes(rows, 200)
    got = near_duplicates(frame(spark, rows), 4).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute.near(rows, 4, 80)


def test_content_decides_where_hashes_agree(spark, monkeypatch):
    """With hashes of few values the results of op8 are the same: windows of one hash are grouped by their bytes."""
    data = np.frombuffer(b"abcabcabdabcabd" * 3, np.uint8)
    at = np.arange(len(data) - 5)
    which = np.array([d % 2 for d in data[at]])
    names, first = np.unique(which, return_index=True)
    got = anchors.by_content(names, first, which, data, at, 6)
    want = [bytes(data[i : i + 6]) for i in at]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(at)) for j in range(len(at)))
    name = {w: k for k, w in enumerate(dict.fromkeys(want))}
    which = np.array([name[w] for w in want])
    names, first = np.unique(which, return_index=True)
    assert anchors.by_content(names, first, which, data, at, 6) is which


def test_copies_of_rows(spark):
    """Rows with one id and text, many times: every copy loses what the contract says, and no list holds the runs of all copies."""
    t = texts(11, 4)
    rows = [(1, t[0] + " " + t[1])] * 30 + [(2, t[0] + " end " + t[1])] * 30
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_shared(frame(spark, rows)).collect())
    assert got == sorted(x[:3] for x in brute.shared_words(rows, 50))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == sorted(x[:3] for x in brute.repeated_bytes(rows, 200))


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 50)), max_size=300))
def test_multikey_quicksort(rows):
    keys = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    small, anchors.SMALL = anchors.SMALL, 4
    try:
        order = anchors.multikey_quicksort(keys) if rows else []
    finally:
        anchors.SMALL = small
    assert [rows[i] for i in order] == sorted(rows)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "LIST", block)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [[r.choice(vocab) for _ in range(r.randint(3, 70))] for _ in range(12)]
    for i in range(90):
        w = list(base[i % 12])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows += [(90, ""), (91, None), (92, "w1 w2"), (93, "W1  w2")]
    for size in (4, 5):
        got = sorted(map(tuple, near_duplicates(frame(spark, rows), size).select("doc_id", "n_shingles", "component_id").collect()))
        assert got == brute.near(rows, size, 80)
    kept = near_duplicates(frame(spark, rows), 4).where("kept <> (doc_id = component_id)")
    assert kept.count() == 0


@pytest.mark.parametrize("leaders", [1, 4])
def test_large_families(spark, leaders, monkeypatch):
    """Chains and rings of near copies that no leader spans, in families of many blocks, and lists of several blocks."""
    for name, value in {"BLOCK": 4, "LIST": 5, "LEADERS": leaders, "FRONT": 2}.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    r = random.Random(12)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(60)]
        for k in range(45):  # a window that moves: neighbours are near, far ones are not
            rows.append((len(rows), " ".join(base[k % 45 // 3 :] + [f"c{c}x{i}" for i in range(k % 45 // 3)])))
        for _ in range(15):
            w = list(base)
            w[r.randrange(60)] = "edit"
            w[r.randrange(60)] = "other"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = sorted(map(tuple, near_duplicates(frame(spark, rows), 4).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute.near(rows, 4, 80)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + (0.05 if i >= 60 else 0) * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(300, rows[0][1], 2), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] * 16, 1), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = [np.array(v, float) if v and None not in v else None for _, v, _ in rows]
    x = [v / np.linalg.norm(v) if v is not None and np.isfinite(v).all() and v.any() else None for v in x]
    link = lambda a, b: x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]) and float(x[a] @ x[b]) >= 0.9
    comp = brute.least_reachable(len(rows), link)
    links = [sum(link(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id").collect()))
    true = sum(links)
    assert sum(g[1] for g in got) >= 0.9 * true
    assert all(g[1] <= n for g, n in zip(got, links, strict=True))
    assert sum(g[2] == c for g, c in zip(got, comp, strict=True)) >= 0.95 * len(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_are_rare_and_shards_many(spark, monkeypatch):
    """With links of few vectors only and many shards, pairs just above the threshold are found all the same."""
    for name, value in {"SHARD": 5, "AUDIT": 1, "SAMPLE": 500, "PLANTED": 100, "FAN": 20, "SPLIT": 40, "LIMIT": 30, "ROUTED": 300}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=(60, 64))
    u -= (u * x[:60]).sum(1)[:, None] * x[:60]
    y = 0.901 * x[:60] + np.sqrt(1 - 0.901**2) * u / np.linalg.norm(u, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).where("n_links > 0").collect()}
    assert set(got) <= {*range(60), *range(2000, 2060)} and len(got) >= 0.9 * 120


def test_embedding_shards_that_nothing_splits(spark, monkeypatch):
    """One dense group of vectors, larger than a shard may be, beside others: blocks in pairs compare it, and recall is told."""
    for name, value in {"SHARD": 8, "SAMPLE": 200, "FAN": 16, "SPLIT": 60, "LIMIT": 40, "ROUTED": 100, "SHRINK": 0.2}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=24)
    x = np.concatenate([base + 0.02 * rng.normal(size=(150, 24)), rng.normal(size=(150, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = [int(k) - 1 for k in (u @ u.T >= 0.9).sum(1)]
    got = sorted(embedding_dedup.near_duplicates(df).collect())
    assert sum(r.n_links for r in got) >= 0.9 * sum(want) and all(r.n_links <= w for r, w in zip(got, want, strict=True))
    assert {r.recall for r in got} and got[0].recall >= 0.9 and len({r.component_id for r in got[:150]}) == 1


def cosine_links(x, least=0.9):
    """Numbers of links and least reachable rows, by brute force."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            return near.sum(1), label
        label = new


def embedding_rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def same_as_brute_force(got, x, least=0.9):
    links, label = cosine_links(x, least)
    rows = {r.vec_id: r for r in got}
    assert [rows[i].n_links for i in range(len(x))] == links.tolist() and [rows[i].component_id for i in range(len(x))] == label.tolist()


@pytest.mark.parametrize("why", ["recall", "no link seen"])
def test_embedding_exact_way_out(spark, monkeypatch, why):
    """If the search stays below the recall asked for, or recall can't be told, all classes are compared, also those that share no shard."""
    for name, value in {"SHARD": 4, "FAN": 30, "SPLIT": 10, "LIMIT": 7, "AGAIN": 0, "PLANTED": 1, "MEET": 0.0, "OVERLAP": 1}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    monkeypatch.setattr(embedding_dedup, "range_search", lambda x, table, least, asking: iter([(np.zeros(0, np.int64), np.zeros(0, np.int64))]))
    if why != "recall":
        monkeypatch.setattr(embedding_dedup, "audit", lambda classes, total, least: ({}, False))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 8))
    got = embedding_dedup.near_duplicates(embedding_rows(spark, x), 0.6).collect()
    assert cosine_links(x, 0.6)[0].sum() > 50 and {r.recall for r in got} == {1.0}
    same_as_brute_force(got, x, 0.6)


def test_embedding_depth(spark, monkeypatch):
    """Shards of any depth have names of their own, and a vector has a bounded number of copies at all depths."""
    for name, value in {"SHARD": 3, "FAN": 4, "SPLIT": 8, "LIMIT": 8, "SHRINK": 0.98, "WIDEST": 0.5}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    names = []
    named = embedding_dedup.named
    monkeypatch.setattr(embedding_dedup, "named", lambda *x: (names.append(x), named(*x))[1])
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 6))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(unit)], "node long, vec binary")
    got = embedding_dedup.shards(classes, 0.95, 1).collect()
    assert len(names) >= 4 and {r.node for r in got} == set(range(700)) and len({r.shard for r in got}) > 60
    copies = np.bincount([r.node for r in got])
    assert copies.max() <= 2 * len(names) and copies.mean() < 8


def test_embedding_many_near_copies(spark):
    """A shard of 20,000 near copies: no pair of them is enumerated, counts are exact."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=16) + 0.001 * rng.normal(size=(20_000, 16)), rng.normal(size=(300, 16))])
    got = embedding_dedup.near_duplicates(embedding_rows(spark, x)).collect()
    assert {r.recall for r in got} == {1.0}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert min(r.n_links for r in got if r.vec_id < 20_000) >= 19_999 and {r.component_id for r in got if r.vec_id < 20_000} == {0}
    want = [int((unit @ unit[i] >= 0.9).sum()) - 1 for i in range(20_000, 20_300)]
    assert [r.n_links for r in sorted(got) if r.vec_id >= 20_000] == want


def test_embeddings_of_the_tables_at_a_lower_threshold(spark):
    """The given tables have no pair at 0.9; at 0.4 they have links, which are the same as by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    assert cosine_links(x, 0.4)[0].sum() > 100
    same_as_brute_force(embedding_dedup.near_duplicates(df, 0.4).collect(), x, 0.4)


def test_ball_counts():
    """Pairs of a ball count in their first common shard, and between blocks only where the cell is one of two blocks."""
    far = embedding_dedup.FAR
    member, block, rows = np.array([[1, 5], [1, 5], [5, far], [5, far], [3, 5]]), np.array([0, 1, 0, 1, 1]), np.array([1, 2, 3, 4, 5])
    pair = lambda u, v, apart: min(set(member[u]) & set(member[v])) == 5 and (not apart or block[u] != block[v])
    for apart in (False, True):
        want = [sum(int(rows[v]) for v in range(5) if u != v and pair(u, v, apart)) for u in range(5)]
        assert embedding_dedup.ball_counts(member, block, rows, 5, not apart).tolist() == want


def test_embedding_audit(spark, monkeypatch):
    """The audit goes on until enough vectors with links are seen; recall counts each of them alike."""
    monkeypatch.setattr(embedding_dedup, "AUDIT", 2)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:3] * [[1.0]] + 1e-3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(x)], "node long, rows long, vec binary")
    want = {i: int((x @ x[i] >= 0.9).sum()) - 1 for i in range(303)}
    assert embedding_dedup.audit(classes, 303, 0.9) == ({i: n for i, n in want.items() if n}, True)
    assert embedding_dedup.audit(classes.where("node between 3 and 299"), 297, 0.95) == ({}, True)
    assert embedding_dedup.mean_recall({1: 1000, 2: 1}, {1: 1000}) == 0.5 and embedding_dedup.mean_recall({}, {}) is None


def test_texts_are_shuffled_once(spark):
    """Cutting windows from texts and joining the runs found to them share one exchange of texts (op1, op8)."""
    part = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"a{k} " * 30 + part + f" b{k}" * 30, "x") for k in range(20)], "doc_id long, text string, source string")
    for out in (remove_shared(docs), remove_repeats(docs)):
        rows = out.collect()
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
        assert all(r.n_removed for r in rows if r.doc_id) and {r.source for r in rows} == {"x"}
