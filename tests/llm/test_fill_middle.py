import hashlib
import random
import re

import numpy as np
import pytest

from strandloom.llm import queries
from strandloom.llm.fill_middle import Runs, rearranged, restored

PATTERN = {"lines": r"[^\n]*\n|[^\n]+", "chars": r"(?s).", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"}
TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "é\n中😀\n\nx y\n", "  a  b ", "a<P>b\nc\n", "a<\nP>\n", "<", "x\r\ny\r\n", "\x00\n\x00", "<S", "a<P\nS>b\n"]


def plain_form(doc_id, text, units="lines", seed=7, rate=100, spm=50):
    text = text or ""
    parts = re.findall(PATTERN[units], text)
    assert "".join(parts) == text
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("units", ["lines", "words", "chars"])
def test_against_plain_code(spark, units):
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("ab\n é中😀\t<PSM>") for _ in range(r.randrange(40))) for _ in range(300)] + ["line é\n" * 50_000 + "end", "x" * 300_000]
    ids = [None if i == 3 else i // 2 - 20 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, range(len(texts)), texts, ["c"] * len(texts), strict=True)), "doc_id long, at int, text string, form string").repartition(3)
    out = rearranged(df, units, rate=80, spm=40)
    assert out.columns == ["doc_id", "at", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", restored("output", "form")).collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plain_form(x.doc_id, texts[x.at], units, rate=80, spm=40)
        assert x.back == (texts[x.at] or "")
    assert {x.form for x in rows} == {"plain", "psm", "spm"}


def test_runs_are_few():
    """What is stored depends on the changes of class, not on the length: a text of one class is one run."""
    buf = np.frombuffer(("a" * 1000 + "\n" * 500).encode(), np.uint8)
    runs = Runs(buf, np.array([0, len(buf)]), "lines")
    assert len(runs.start) == 3 and runs.n.tolist() == [500]
    assert [x.tolist() for x in runs.cut(np.array([0]), np.array([123]), np.array([0]))] == [[1123], [1123]]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a\nb\n", 2), (1, "a\nb\n", 2)], "doc_id long, text string, x int")
    assert rearranged(df.limit(0)).count() == 0
    a, b = rearranged(df).collect()
    assert a == b and a.x == 2
    assert {x.form for x in rearranged(df, rate=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            rearranged(df, sentinels=bad)
    with pytest.raises(ValueError):
        rearranged(df, "pages")
    odd = rearranged(df.withColumnRenamed("doc_id", "id of x"), key="id of x", sentinels=("[pre]", "[suf]", "[mid]"))
    assert odd.columns[0] == "id of x" and odd.where(restored("output", "form", ("[pre]", "[suf]", "[mid]")) == "a\nb\n").count() == 2


def test_query(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    for x in queries.op11_fill_middle(spark, f"file://{tmp_path}").collect():
        n, form, p, m, out = plain_form(x.doc_id, TEXTS[x.doc_id])
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output_sha256) == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
        assert x.restored_sha256 == hashlib.sha256((TEXTS[x.doc_id] or "").encode()).hexdigest()

