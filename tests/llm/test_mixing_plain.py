import re
from collections import defaultdict

import pytest

from strandloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Targets of sources {source: size}: shares of the budget by weight; what goes beyond `most` times a source's size is shared again among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(x) for x in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left, free = {}, budget * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not above:
            return full | {s: left * weight[s] / total for s in free}
        for s in above:
            full[s] = most * sizes[s]
        left -= sum(full[s] for s in above)
        free -= above
    return full


def check(rows, docs):
    sizes, taken, size_of = defaultdict(int), defaultdict(int), {}
    for doc_id, text, source in docs:
        size_of[doc_id] = len(WORD.findall(text or ""))
        sizes[source] += size_of[doc_id]
    source_of = {d: s for d, _, s in docs}
    want = plain_targets(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.size == size_of[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    longest = defaultdict(int)
    for d, s in source_of.items():
        longest[s] = max(longest[s], size_of[d])
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.03 * want[s], 2 * longest[s])


def test_targets_of_the_query_against_plain_code(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    check(queries.op6_source_mixing(spark, path).collect(), docs)


def test_hot_small_and_null_sources(spark, tmp_path):
    """A source with most words, small ones that their caps stop one after the other, a null source, one without words, and order by code point."""
    docs = [(i, "w " * (40 + i % 7), "big") for i in range(300)] + [(1000 + i, "a b c", x) for i, x in enumerate(["B", "a", "Z", "é", "😀", "", None, None, "B"])] + [(2000, None, "void"), (2001, "\t\n ", "void")]
    spark.createDataFrame([(*d, None, None) for d in docs], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    check(queries.op6_source_mixing(spark, f"file://{tmp_path}").collect(), docs)
