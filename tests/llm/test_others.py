import base64
import hashlib
import math
import random
import re
import warnings

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import bpe, mixing, quality_classifier, quality_rules, queries, url_filter, warc

from . import brute

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, encoding):
    r = random.Random(3)
    alphabet = list("ab's  \n\t'rvemldtLL12 .,!?é中\u00a0\u3000😀\r'\x1c\x85") + ["<|endoftext|>"]
    rows = ["", None, " ", "'s", " 's", "\n's", "it's's 'll", "''s", "a \n b  ", "x" * 5000] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int")
    ids = {r.doc_id: r.input_ids for r in bpe.encode(df, PATH).collect()}
    assert all(ids[i] == encoding.encode_ordinary(t or "") for i, t in enumerate(rows))
    for x in bpe.round_trip(df, PATH).collect():
        text = (rows[x.doc_id] or "").encode()
        assert x.decoded_sha256 == hashlib.sha256(text).hexdigest()
        assert x.n_tokens == len(ids[x.doc_id])
        assert x.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids[x.doc_id])).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def thue_morse(n, letters="ab"):
    word = letters[0]
    while len(word) < n:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_bpe_of_long_and_patterned_pieces(spark, encoding):
    """Pieces that a weak hash confuses, and long ones without a blank: in a time that grows with their length."""
    import time

    r = random.Random(8)
    other = str.maketrans("ab", "ba")
    rows = [thue_morse(n) + " " + thue_morse(n).translate(other) for n in (64, 1024, 2048)]
    rows += ["".join(r.choice("abcdefgh") for _ in range(200_000)), "".join(r.choice("ab") for _ in range(65)), "中文" * 20_000, "-" * 3000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    ids = {x.doc_id: x.input_ids for x in bpe.encode(df, PATH).collect()}
    assert all(ids[i] == encoding.encode_ordinary(t) for i, t in enumerate(rows))
    vocab = bpe.vocabulary(PATH)
    took = []
    for n in (50_000, 400_000):
        data = "".join(r.choice("abcdefgh") for _ in range(n)).encode()
        began = time.time()
        vocab.merge_long(data)
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1


def test_bpe_hashes_that_agree(encoding, monkeypatch):
    """Pieces with one hash are told apart by their bytes."""
    import pyarrow as pa

    from strandloom.llm.common import text_slices

    real = bpe.slice_hashes
    monkeypatch.setattr(bpe, "slice_hashes", lambda b, s, e, seed=0: real(b, s, e, seed) if seed > 1 else (real(b, s, e, seed) % 3 if len(b) else real(b, s, e)))
    vocab = bpe.Vocabulary(PATH)
    for t in ["international internationalism constitution", "constitution a b c institutions", "international"]:
        for _, _, buf, offsets in text_slices(pa.array([t])):
            assert bpe.encode_slice(vocab, buf, offsets)[0].tolist() == encoding.encode_ordinary(t)


@given(st.lists(st.text(alphabet="ab1's  \n\tvlre.é中", max_size=60), max_size=6), st.integers(1, 9))
def test_piece_starts(texts, block):
    import numpy as np
    import regex

    codes = np.array([ord(c) for t in texts for c in t], np.uint32)
    rows = np.cumsum([0, *map(len, texts)])
    want = [int(rows[i]) + m.start() for i, t in enumerate(texts) for m in regex.finditer(tokenizers.PATTERN, t)]
    old, bpe.BLOCK = bpe.BLOCK, block
    try:
        assert bpe.piece_starts(codes, rows).tolist() == want
    finally:
        bpe.BLOCK = old


def test_bpe_cache_limit(encoding, monkeypatch):
    import pyarrow as pa

    from strandloom.llm.common import text_slices

    monkeypatch.setattr(bpe, "CACHE", 3)
    vocab = bpe.Vocabulary(PATH)
    rows = ["one two three four five", "six seven eight", "nine ten one two"] * 3
    for t in rows:
        for _, _, buf, offsets in text_slices(pa.array([t])):
            assert bpe.encode_slice(vocab, buf, offsets)[0].tolist() == encoding.encode_ordinary(t)


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "c", "d", None, "B"])) for i in range(600)] + [(600, None, "a"), (601, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.allocate(df).collect()
    assert len(got) == len(rows)
    size = {}
    for x in got:
        n = len(brute.words(rows[x.doc_id][1]))
        assert x.size == n and x.taken <= 2 * n and x.taken == n * len(x.draws)
        size[rows[x.doc_id][2]] = size.get(rows[x.doc_id][2], 0) + n
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, total = dict.fromkeys(order, 0.0), 1.5 * sum(size.values())
    capped: set = set()
    while True:  # plain resharing
        left = total - sum(2 * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / w for s in order}
        new = {s for s in order if s not in capped and target[s] > 2 * size[s]}
        if not new:
            break
        capped |= new
    taken = dict.fromkeys(order, 0)
    for x in got:
        s = rows[x.doc_id][2]
        assert x.source_size == size[s] and math.isclose(x.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        taken[s] += x.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert sorted(map(str, mixing.allocate(df).collect())) == sorted(map(str, got))
    assert mixing.mix(df).count() == sum(len(x.draws) for x in got)
    assert mixing.allocate(df.limit(0)).count() == 0


def test_taken_is_counted_in_the_mix(spark, tmp_path, monkeypatch):
    rows = [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(60)] + [(60, "w w w", "a")] * 2 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda: sorted(map(str, queries.op6_source_mixing(spark, str(tmp_path)).collect()))
    assert query() == sorted(map(str, mixing.allocate(df).select("doc_id", "size", "source_size", "target", "taken").collect()))
    whole = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: whole(*a, **k).where("source = 'a'"))
    lost = queries.op6_source_mixing(spark, str(tmp_path)).join(df.select("doc_id", "source").distinct(), "doc_id").groupBy("source").sum("taken")
    lost = {r[0]: r[1] for r in lost.collect()}
    assert lost["b"] == 0 < lost["a"]


def test_mixing_in_many_shards(spark, monkeypatch):
    """More shards than blocks of a source, many blocks, and rows without words: every draw has a shard, and settings change no draw."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([0, 0, 3, 9])), r.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = {}
    for shards in (1, 7, 500):
        got = mixing.allocate(df, shards=shards).collect()
        assert all(0 <= d.shard < shards for x in got for d in x.draws)
        seen[shards] = sorted((x.doc_id, x.taken, len(x.draws)) for x in got)
    assert seen[1] == seen[7] == seen[500]
    assert mixing.mix(df, shards=500).count() == sum(x[2] for x in seen[1])
    assert mixing.block_count(10**10) >= 10**10 // (2 * mixing.BLOCK_ROWS) and mixing.block_count(5) == mixing.BLOCKS
    monkeypatch.setattr(mixing, "SHARES", 8)
    assert sorted((x.doc_id, x.taken, len(x.draws)) for x in mixing.allocate(df, shards=7).collect()) == seen[7]


def test_splitting_tree():
    quota = [100, 3, 0, 57]
    out = mixing.split(quota, 8, "s")
    assert [sum(x) for x in zip(*out, strict=True)] == quota and len(out) == 8
    assert max(map(sum, out)) - min(map(sum, out)) <= 3
    rng = random.Random(1)
    draws = [mixing.hypergeometric(50, 20, 10, rng) for _ in range(4000)]
    assert abs(sum(draws) / len(draws) - 4) < 0.1


def test_quality_rules(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "x\nx\n \nx"), (5, " ".join(["a b c d e f g h i"] * 3)), (6, "é # 😀 <b> " * 30)]
    rows += [(i, " ".join(r.choice(vocab[: r.choice([1, 2, 30])]) for _ in range(r.randint(0, 90)))) for i in range(7, 80)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int")
    for x in quality_rules.judge(df).collect():
        t = dict(rows)[x.doc_id] or ""
        w = brute.words(t)
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        rep = sum(brute.covered(len(w), [k for k, v in enumerate(win) if win.count(v) > 1], 8))
        lines = [y for y in t.split("\n") if brute.words(y)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert x.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (x.base_failed and x.kept)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_verdicts_of_quality_rules(spark, tmp_path):
    """The query's kept, row by row, against votes, rates and posteriors by plain code."""
    import regex

    folder = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}

    def votes(t):
        w = brute.words(t)
        n, chars, lines = max(1, len(w)), sum(map(len, w)), [y for y in t.split("\n") if brute.words(y)]
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        rep = sum(brute.covered(len(w), [k for k, v in enumerate(win) if win.count(v) > 1], 8))
        dup, marks, symbols = len(lines) - len(set(lines)), len(regex.findall(r"[!?#*$%&]{2,}|\|", t)), len(re.findall(r"[#*$%&|<>]", t))
        upper, letters = len(regex.findall(r"\p{Lu}", t)), len(regex.findall(r"\p{L}", t))
        pick = lambda bad, good: -1 if bad else 1 if good else 0
        v = (
            pick(len(w) < 20, len(w) >= 60), pick(chars < 3 * n or chars > 12 * n, 4 * n <= chars <= 9 * n), pick(symbols * 10 > n, symbols * 50 <= n), pick(dup >= 3, dup == 0),
            pick(100 * rep > 30 * n, 100 * rep <= 5 * n), pick(upper * 10 > letters * 4, upper * 10 <= letters), pick(marks * 20 > n, marks * 100 <= n),
        )
        return v, len(w) < 20 or 100 * rep > 30 * len(w)

    seen = {i: votes(t) for i, t in texts.items()}
    counts: dict = {}
    for v, _ in seen.values():
        counts[v] = counts.get(v, 0) + 1
    good, rates = quality_rules.estimate(sorted(counts.items()))
    got = {x.doc_id: (x.base_failed, x.kept) for x in queries.op7_quality_rules(spark, folder).collect()}
    assert got == {i: (failed, not failed and quality_rules.posterior(v, good, rates) >= quality_rules.KEEP_FROM) for i, (v, failed) in seen.items()}


def test_weak_supervision():
    """Rates of three rules that see a hidden class are found again."""
    r = random.Random(7)
    seen: dict = {}
    for _ in range(20000):
        good = r.random() < 0.8
        v = tuple((r.choices([-1, 0, 1], [0.02, 0.2, 0.78])[0] if good else r.choices([-1, 0, 1], [0.6, 0.2, 0.2])[0]) for _ in range(4))
        seen[v] = seen.get(v, 0) + 1
    share, rates = quality_rules.estimate(sorted(seen.items()))
    assert abs(share - 0.8) < 0.03 and all(abs(a[0] - 0.02) < 0.02 and abs(b[0] - 0.6) < 0.05 for a, b in rates)


def test_quality_classifier(spark):
    r = random.Random(8)
    say = lambda: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80)))
    rows = [(i, say() if i % 5 else say().upper().replace(" ", "!! ")) for i in range(1500)] + [(1500, ""), (1501, None), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 1500, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out)
    test = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 1500]
    assert len(test) > 200 and sum(x.predicted == int(x.doc_id % 5 > 0) for x in test) >= 0.98 * len(test)
    import zlib

    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    assert quality_classifier.classify(docs, labels.limit(0)).count() == len(rows)


def test_scores_are_a_text_s_own(spark):
    """A row's score depends on the model and its text alone, not on the rows that it is scored with, and a very long text has one too."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(9)
    rows = ["", "a", "x " * 300_000, "é!? " * 50, "A|B\n" * 9] + ["".join(r.choice("ab c\nD1#") for _ in range(r.randint(0, 200))) for _ in range(60)]
    model = np.array([r.uniform(-1, 1) for _ in range(276)]), np.zeros(276), np.ones(276)
    score = lambda texts: np.concatenate([quality_classifier.scores(x, model) for _, _, x in quality_classifier.features(pa.array(texts, pa.string()))])
    together, alone = score(rows), np.concatenate([score([t]) for t in rows])
    assert np.allclose(together, alone, atol=1e-6) and len(together) == len(rows)


def test_class_prior():
    """The share of good rows among unlabelled ones is found from scores, whatever the share."""
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        n = int(3000 * share)
        unlabelled = np.concatenate([rng.beta(8, 2, n), rng.beta(2, 8, 3000 - n)])
        assert abs(quality_classifier.class_prior(rng.beta(8, 2, 3000), unlabelled) - share) < 0.08
    assert quality_classifier.class_prior(np.zeros(0), np.zeros(3)) == 0.5


def test_no_positive_labels(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "some words " * (i + 1)) for i in range(20)], "doc_id long, text string")
    path = corpus_pipeline.shared_folder(spark)
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    with pytest.warns(UserWarning, match="labelled 1"):
        assert {x.predicted for x in quality_classifier.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()} == {None}
        assert corpus_pipeline.quality(spark, docs, path).count() == 20
        docs.write.parquet(f"{path}/documents.parquet")
        assert {(x.score, x.predicted) for x in queries.op5_quality_classifier(spark, path).collect()} == {(0.5, 0)}


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def test_url_filter(spark):
    urls = ["http://a.EXAMPLE.net/en/1?x=1", "https://example.net/de/", "http://net", "ftp://b.example.com/de/#t", "http://xexample.com/de/", "http://x.org/fr/", "nothing", None, "", "http://", "http://a.net?/en/", "http://spam-farm.example.org/en/1", "http://É.Org/FR/", "a://b://c.net/x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: (x.host, x.path, x.rule) for x in url_filter.judge(df, RULES).collect()}
    want = {0: ("a.example.net", "/en/1", "example.net/en/"), 1: ("example.net", "/de/", "net/"), 2: ("net", "", None), 3: ("b.example.com", "/de/", "example.com/de/"), 4: ("xexample.com", "/de/", None), 5: ("x.org", "/fr/", "org/fr/"), 6: ("", "", None), 7: ("", "", None), 8: ("", "", None), 9: ("", "", None), 10: ("a.net", "", None), 11: ("spam-farm.example.org", "/en/1", None), 12: ("É.org", "/FR/", None), 13: ("b:", "//c.net/x", None)}
    assert got == want
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_other_columns_stay(spark):
    """Columns whose names the operators use inside come through; empty tables and repeated rows are fine."""
    inner = ["_w", "_l", "_h", "_x", "_many", "_s", "_p", "_text", "row", "fit", "_length", "_depth", "_entropy", "_suffix", "_share", "_fit", "_", "text2"]
    rows = [(1, "a b c d", "http://casino.example.org/a/1?b=2", *inner)] * 2 + [(None, None, None, *inner)]
    df = spark.createDataFrame(rows, ", ".join(["page_id long", "text string", "url string", *(f"`{n}` string" for n in inner)]))
    for out in (quality_rules.judge(df), quality_rules.judge(df, keep_text=False), url_filter.judge(df, RULES)):
        got = out.collect()
        assert len(got) == 3 and all(x[n] == n for x in got for n in inner) and sorted(x.page_id or 0 for x in got) == [0, 1, 1]


def test_probabilities_of_the_fitted_model(spark, monkeypatch):
    """op3's probability and verdict of each page, against plain code for features, bins and trees."""
    folder, seen = "/root/testdata/sf0.01", {"cuts": []}
    cuts, boost = url_filter._cuts, url_filter.boost
    monkeypatch.setattr(url_filter, "_cuts", lambda v: seen["cuts"].append(cuts(v)) or seen["cuts"][-1])
    monkeypatch.setattr(url_filter, "boost", lambda *a: seen.setdefault("model", boost(*a)))
    got = queries.op3_url_filter(spark, folder).collect()
    start, trees = seen["model"]
    urls = {x.page_id: x.url for x in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    bad = re.compile("(^|[.-])(" + "|".join(url_filter.BAD_WORDS) + ")([.-]|$)")

    def parts(url):
        rest = (url or "").split("://", 1)
        host = re.match(r"[^/?#]*", rest[1])[0] if len(rest) > 1 else ""
        return brute.lower(host), re.match(r"[^/?#]*([^?#]*)", rest[1])[1] if len(rest) > 1 else ""

    tail = lambda host: ".".join(host.split(".")[-2:])
    labelled = [(tail(parts(u)[0]), int(bool(bad.search(parts(u)[0])))) for u in urls.values() if u and "://" in u]
    base = (sum(y for _, y in labelled) + 1) / (len(labelled) + 2)
    share = lambda s: (sum(y for t, y in labelled if t == s) + 10 * base) / (sum(t == s for t, _ in labelled) + 10) if any(t == s for t, _ in labelled) else base

    def numbers(url):
        host, text = parts(url)[0], url or ""
        freq = [host.count(c) / max(1, len(host)) for c in url_filter.ALPHABET]
        query = re.search(r"\?([^#]*)", text)
        return [
            len(text), len(host), len(re.findall(r"/[^/]+", parts(url)[1])), len(re.findall("[0-9]", text)) / max(1, len(text)), round(-sum(x * math.log2(x) for x in freq if x > 0), 9),
            len(re.findall("[^&]+", query[1])) if query else 0, host.count("-"), len(re.findall(r"[^.]+", host)), max(map(len, host.split("."))), share(tail(host)),
        ]

    def value(tree, x):
        while "value" not in tree:
            tree = tree["left"] if x[tree["feature"]] < seen["cuts"][tree["feature"]][tree["bin"] - 1] - 1e-12 else tree["right"]
        return tree["value"]

    assert len(got) == len(urls)
    for x in got:
        p = 1 / (1 + math.exp(-start - sum(value(t, numbers(urls[x.page_id])) for t in trees)))
        assert math.isclose(x.bad, p, abs_tol=1e-9), urls[x.page_id]
        assert x.rule is not None or x.verdict == ("block" if p >= url_filter.BLOCK_FROM else "allow")


def test_model_on_hosts_that_it_has_not_seen(spark):
    """Fitted on URLs of one half of the hosts, the model finds the bad ones of the other half, which suffix shares alone can't tell apart."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host = url_filter.split_url(F.col("url"))[0]
    half = F.crc32(F.substring_index(host, ".", -3).cast("binary")) % 2
    labelled = url_filter.labelled_urls(pages)
    out = url_filter.judge(pages.where(half == 1), (), labelled=labelled.where(half == 0))
    truth = url_filter.labelled_urls(pages.where(half == 1)).distinct()
    got = out.join(truth.withColumnRenamed("bad", "label"), "url").groupBy("label", "verdict").count().collect()
    n = {(x["label"], x.verdict): x["count"] for x in got}
    assert n.get((1, "block"), 0) >= 20 and n.get((1, "allow"), 0) <= 0.1 * n[1, "block"] and n.get((0, "block"), 0) <= 0.02 * n[0, "allow"]
    suffixes = out.groupBy(url_filter.suffix(F.col("host")).alias("s")).count().collect()
    assert len(suffixes) <= 4  # each suffix has good hosts and bad ones


def test_boosted_trees():
    r = random.Random(2)
    bins = [[r.randrange(8) for _ in range(600)] for _ in range(3)]
    bad = [int((a > 4) != (b > 3)) for a, b in zip(bins[0], bins[1], strict=True)]
    start, trees = url_filter.boost(bins, bad)

    def score(i):
        x = start
        for t in trees:
            while "value" not in t:
                t = t["left"] if bins[t["feature"]][i] < t["bin"] else t["right"]
            x += t["value"]
        return x

    assert sum((score(i) > 0) == bool(y) for i, y in enumerate(bad)) >= 0.98 * len(bad)


def test_warc(spark):
    bodies = ["same", "same", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5", "", None, "é😀", "same", "x" * 100_000, "y" * 2_000_000]
    pages = spark.createDataFrame([(i * 3, f"http://h/{i}\r\n", b, 1) for i, b in enumerate(bodies)], "page_id long, url string, html string, other int")
    got = {re.search(r"pageId: (\d+)", x.metadata.fields)[1]: x for x in warc.archived(pages).collect()}
    assert len(got) == len(bodies)
    data = [(b or "").encode() for b in bodies]
    for i, b in enumerate(data):
        x = got[str(i * 3)]
        last = max(k for k, y in enumerate(data) if y == b)
        assert x.main.digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert x.request.content_type.startswith("application/http")
        if last == i:
            assert x.main.record_type == "response" and bytes(x.main.payload) == b and x.main.payload_bytes == len(b)
        else:
            assert x.main.record_type == "revisit" and x.main.refers_to.startswith(f"<urn:page:capture:{last * 3}:") and x.original.payload_bytes == len(b)
    assert len({x.main.record_id for x in got.values()}) == len(bodies)
    long = {x.main.record_type for x in warc.archived(pages, least=10**9).collect()}
    assert long == {"response"}
    assert warc.archived(pages.limit(0)).count() == 0


def op10(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, rk string, copies int, _s int").write.parquet(f"{path}/pages.parquet")
    return sorted(((x.page_id or 0, x.payload_bytes, x.record_type, x.refers_to) for x in queries.op10_warc(spark, str(path)).collect()), key=str)


def test_pages_with_repeated_or_null_keys(spark, tmp_path, monkeypatch):
    """One record and one row for every row, whatever its key; of equal payloads the largest key responds, of equal rows one copy."""
    monkeypatch.setattr(warc, "COPIES", 2)
    extra = ("x", 3, 4)
    rows = [(5, "u", "same"), (5, "u", "same"), (3, "u", "same"), (None, "u", "x"), (5, "v", "same"), (None, "u", "same"), (None, "u", "same"), (None, "w", "lone"), (None, "w", "lone"), (None, "z", "lone"), (8, None, None), (9, None, "")]
    rows += [(7, "a", "many")] * 7
    got = op10(spark, tmp_path, [(*r, *extra) for r in rows])
    want = [(0, 1, "response", None), (0, 4, "response", None), *[(0, 4, "revisit", None)] * 2, *[(0, 4, "revisit", 5)] * 2, (3, 4, "revisit", 5)]
    want += [(5, 4, "response", None), *[(5, 4, "revisit", 5)] * 2, (7, 4, "response", None), *[(7, 4, "revisit", 7)] * 6, (8, 0, "revisit", 9), (9, 0, "response", None)]
    plain = lambda x: sorted(x, key=str)
    assert plain(got) == plain(want)


def test_pages_below_the_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = sorted((x.main.payload_bytes, x.main.record_type, x.main.record_id) for x in warc.archived(pages, least=3, with_payload=False).where("main.payload_bytes is not null").collect())
    assert [x[:2] for x in got] == [(2, "response")] * 3 + [(4, "response")] and len({x[2] for x in got}) == 4


def test_queries_and_their_sql(spark):
    """The queries whose whole result the contract fixes, with DuckDB on the same tables."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, folder)
        want = db.execute(sql)
        columns = [x[0] for x in want.description]
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str), name


def test_pipeline(spark):
    import corpus_pipeline

    r = random.Random(3)
    say = lambda k: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(k))
    shared = say(60)
    rows = [(i, say(60) + (" " + shared if i % 10 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(20)] + [(300 + i, say(40).upper().replace(" ", "!! "), "en", "s1", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(x[0], int(x[0] < 300), 0) for x in rows], "doc_id long, quality int, toxic int")
    path = corpus_pipeline.shared_folder(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, path).write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        seen.append(now)
    assert sorted(x.doc_id for x in seen[1].select("doc_id").collect()) == list(range(200))
    assert not any(shared[:200] in x.text for x in seen[2].collect())
    assert seen[3].columns == docs.columns and 250 <= seen[3].count() <= 350
    assert corpus_pipeline.run(spark, path).count() == seen[4].count() == seen[3].count()


def test_pipeline_on_hard_rows(spark):
    """Null ids, texts and sources, empty texts, equal rows and a clashing column; then no rows at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    r = random.Random(4)
    say = lambda k: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(k))
    rows = [(i, say(50), "en", f"s{i % 2}", 0, "x") for i in range(40)]
    rows += [rows[0], (None, rows[1][1], "en", "s0", 0, "x"), (None, None, None, None, None, None), (50, None, "en", None, 0, "x"), (51, "", "en", "s1", 0, "x")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    for data in (rows, []):
        path = corpus_pipeline.shared_folder(spark)
        spark.createDataFrame(data, schema).write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        now, seen = spark.read.parquet(f"{path}/documents.parquet"), []
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for name, stage in corpus_pipeline.STAGES:
                stage(spark, now, path).write.parquet(f"{path}/{name}")
                now = spark.read.parquet(f"{path}/{name}")
                seen.append(now)
        kept = [x.doc_id for x in seen[1].collect()]
        assert len(kept) == len([x for x in kept if x is not None and x < 40]) + sum(x is None or x >= 40 for x in kept) and kept.count(0) <= 1
        assert seen[3].columns == spark.createDataFrame([], schema).columns
        assert seen[4].count() == seen[3].count() and (data or not seen[4].count())
