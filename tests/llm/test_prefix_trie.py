import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import prefix_trie
from strandloom.llm.common import WORD
from strandloom.llm.prefix_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows, family=20, heads=4):
    import re

    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for conv, t in turns.items():
        h = zlib.crc32(str(conv).encode()) % heads
        base = conv - (abs(conv) % family) * (1 if conv >= 0 else -1)
        built[conv] = turns.get(base, [])[:h] + t[h:]
    members, last = defaultdict(list), defaultdict(list)
    for conv, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(conv)
        last[tuple(t)].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        gain = (len(m) - 1) * (len(re.findall(WORD, node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += node not in children
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(last[k]))).encode()).hexdigest()) for k, m in members.items()
    )


def result(df, **more):
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie(df, **more).collect())


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(df, **more) == plain_trie(rows, **more)


def conversations(seed, n, deepest=9):
    r = random.Random(seed)
    return [(c, None if t == 2 and c % 3 == 0 else t, r.choice(["user", "assistant", None]) if r.random() < 0.3 else "user", r.choice(["a b", "a", "", None, "c  d\te"]) if t % 3 else "hello you") for c in r.sample(range(-n, 2 * n), n) for t in range(r.randrange(1, deepest))]


def test_against_plain_code(spark):
    check(spark, conversations(1, 60))


def test_rounds_and_pieces(spark, monkeypatch):
    """Copies of a long conversation, a long one of its own, a hot one in many partitions, and broadcast parents."""
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "HOT", 2)
    monkeypatch.setattr(prefix_trie, "LONGEST", 8)
    long = [(c, t, "user", f"word {t % 7}") for c in (3, 21, 22, 45) for t in range(40 if c != 22 else 25)]
    alone = [(100, t, "user", f"x {t}") for t in range(70)]
    check(spark, long + alone + [(c + 1000, *x) for c, *x in conversations(2, 25, 5)])


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "lost")], [(5, 0, "user", "one two")], [(5, 0, "user", "one")] * 3, [(21, 0, "a", "x"), (22, 0, "a", "x"), (23, 0, None, None)], [(c, 0, "user", "same") for c in range(30)]])
def test_edges(spark, rows):
    check(spark, rows, heads=1 + 3 * (len(rows) != 3))


def test_other_columns(spark):
    df = spark.createDataFrame(conversations(3, 10), SCHEMA)
    assert result(df.selectExpr("*", "1 as c", "2 as depth", "3 as n_convs")) == result(df)


def test_long_list_of_ends(spark):
    """Ids that end at one node go through several runs and batches."""
    rows = [(c, 0, "user", "same") for c in range(0, 20 * 6000, 20)]
    check(spark, rows)
