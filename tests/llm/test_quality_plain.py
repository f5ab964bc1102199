import math
import re

import numpy as np

from strandloom.llm import queries
from strandloom.llm.quality_classifier import PAIRS, STYLE, THRESHOLD, train

KINDS = [(b"".join(bytes([i]) for i in range(65, 91)), 0), (bytes(range(97, 123)), 1), (bytes(range(48, 58)), 2), (b"\t\x0b\x0c\r ", 3), (b"\n", 4), (b".,;:", 5), (b"!?", 6), (b"|", 7), (b"#*$%&<>@^~_=+{}[]\\/", 8), (bytes(range(128, 256)), 9)]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_features(text):
    """The features of one text, byte by byte."""
    data = (text or "").encode()
    kind = [next((k for chars, k in KINDS if bytes([b]) in chars), 10) for b in data]
    for i in range(len(data) - 1):
        if data[i] == 0xC3 and 0x80 <= data[i + 1] <= 0x9E:
            kind[i], kind[i + 1] = 10, 0
    count = [kind.count(k) for k in range(11)]
    total, words = max(1, len(data)), WORD.findall(data)
    many = len(words)
    out = [n / total for n in count]
    out.append(count[0] / max(1, count[0] + count[1] + count[9]))
    out.append(math.log1p(many) / 10)
    out.append(sum(map(len, words)) / max(1, many) / 10)
    out.append(1 - len(set(words)) / many if many else 0)
    five = [tuple(words[i : i + 5]) for i in range(many - 4)]
    out.append(1 - len(set(five)) / len(five) if five else 0)
    lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
    out.append(1 - len(set(lines)) / len(lines) if lines else 0)
    out += [many < 20, 1, count[4] / max(1, many)]
    pairs = [0] * PAIRS
    for a, b in zip(data, data[1:], strict=False):
        pairs[(a * 0x9E37 + b * 0x85EB) >> 5 & PAIRS - 1] += 1
    return np.array(out + [math.sqrt(n / total) for n in pairs], np.float64)


def test_scores_of_the_query_against_plain_code(spark):
    """Features, held-out rows, scores and predictions of every row of the query, from a text at a time; the fitted weights are the query's own."""
    import zlib

    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    weights, mean, scale = train(docs, labels)
    assert len(weights) == STYLE + PAIRS
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op5_quality_classifier(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        z = float(np.clip((plain_features(texts[r.doc_id]) - mean) / scale, -8, 8) @ weights)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= THRESHOLD)


def test_rows_without_text_and_with_clashing_names(spark):
    rows = [(i, t, 5, 0.5) for i, t in enumerate([None, "", "\n", "a", "É é\nÉ é\n", "x " * 5000])] + [(None, "no key", 1, 0.0), (3, "same key", 1, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out int, score double")
    from strandloom.llm.quality_classifier import classify

    labels = spark.createDataFrame([(3, 1), (5, 1), (4, 0), (None, 1), (99, 1), (1, None)], "doc_id long, quality int")
    got = classify(docs, labels)
    assert got.columns == ["doc_id", "text", "score", "held_out", "predicted"]
    weights, mean, scale = train(docs, labels)
    for r in got.collect():
        z = float(np.clip((plain_features(r.text) - mean) / scale, -8, 8) @ weights)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-4
    assert got.where("doc_id is null and not held_out").count() == 1
