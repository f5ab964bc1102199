"""Plain versions of operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def covered(n, starts, width):
    gone = [False] * n
    for s in starts:
        gone[s : s + width] = [True] * width
    return gone


def shared_words(docs, width):
    """{row: (n_words, n_removed, sha)} for rows (id, text); a null id comes last."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, float("inf")), order(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = covered(len(w), [k for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < order(i)], width)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(docs, width):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k : k + width] for _, b in data for k in range(len(b) - width + 1))
    out = []
    for i, b in data:
        gone = covered(len(b), [k for k in range(len(b) - width + 1) if count[b[k : k + width]] > 1], width)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size):
    w = words(lower(text))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def least_reachable(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def near(docs, size, percent):
    """(id, n_shingles, component) of rows in order of id."""
    sets = [shingles(t, size) for _, t in docs]
    link = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    comp = least_reachable(len(docs), link)
    return [(docs[i][0], len(sets[i]), docs[comp[i]][0]) for i in range(len(docs))]
