"""Pairwise alignment by dynamic programming, row by row in numpy, for Arrow batches of pairs.

Scores: match, mismatch, ins (a gap in a), delete (a gap in b). Local, global, semi-global (a fixed: all of a, any part of b), and
normalising an aligned pair. Gaps are '-'.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

EDITS = (1.0, -1.0, -1.0, -10.0)


def table(a: str, b: str, match: float, gap_a: float, gap_b: float, sub: float, mode: str) -> np.ndarray:
    """Scores of prefixes. Along a row, gaps in a depend on each other; they are resolved by a running maximum."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n, m = len(x), len(y)
    step = gap_a * np.arange(m + 1)
    h = np.zeros((n + 1, m + 1))
    if mode == "global":
        h[0] = step
    if mode != "local":
        h[:, 0] = gap_b * np.arange(n + 1)
    for i in range(1, n + 1):
        row = h[i]
        best = np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], match, sub), h[i - 1, 1:] + gap_b)
        if mode == "local":
            best = np.maximum(best, 0)
        line = np.concatenate([[row[0]], best])
        row[:] = np.maximum.accumulate(line - step) + step
        if mode == "local":
            np.maximum(row, 0, out=row)
    return h


def aligned(a: str, b: str, mode: str = "local", match: float = 1, gap_a: float = -1, gap_b: float = -1, sub: float = -1) -> tuple[float, str, str, int, int, int, int]:
    """score, a and b with gaps, and begin and end in a and in b (0-based, half-open)."""
    h = table(a, b, match, gap_a, gap_b, sub, mode)
    if mode == "local":
        i, j = np.unravel_index(int(h.argmax()), h.shape)
    elif mode == "global":
        i, j = len(a), len(b)
    else:
        i, j = len(a), int(h[len(a)].argmax())
    score, ei, ej, p, q = float(h[i, j]), int(i), int(j), [], []
    while i > 0 or j > 0:
        if mode == "local" and h[i, j] <= 0 or mode == "fixed" and i == 0:
            break
        if i and j and np.isclose(h[i, j], h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else sub)):
            i, j = i - 1, j - 1
            p.append(a[i]), q.append(b[j])
        elif i and np.isclose(h[i, j], h[i - 1, j] + gap_b):
            i -= 1
            p.append(a[i]), q.append("-")
        else:
            j -= 1
            p.append("-"), q.append(b[j])
    return score, "".join(p[::-1]), "".join(q[::-1]), int(i), ei, int(j), ej


def log_likelihood(a: str, b: str, p: float) -> tuple[float, float]:
    """ln of the probability that b's best part came from a with error rate p, times the number of best ways, and that number:
    a substitution has p * p / 3, an insertion p / 3, a deletion p, a match (1 - p) ** 2."""
    match, sub, ins, dele = 2 * np.log1p(-p), np.log(p * p / 3), np.log(p / 3), np.log(p)
    h = table(a, b, match, ins, dele, sub, "fixed")
    n, m = h.shape
    ways = np.zeros_like(h)
    ways[0] = 1
    for i in range(1, n):
        for j in range(m):
            v = 0.0
            if j and np.isclose(h[i, j], h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else sub)):
                v += ways[i - 1, j - 1]
            if np.isclose(h[i, j], h[i - 1, j] + dele):
                v += ways[i - 1, j]
            if j and np.isclose(h[i, j], h[i, j - 1] + ins):
                v += ways[i, j - 1]
            ways[i, j] = v
    best = h[-1].max()
    count = ways[-1][np.isclose(h[-1], best)].sum()
    return float(best + np.log(max(count, 1))), float(count)


def normalised(a: str, b: str) -> tuple[str, str]:
    """Gaps moved as far left as the letters allow; places with gaps in both are dropped."""
    x, y = map(list, zip(*[(p, q) for p, q in zip(a, b, strict=True) if not p == q == "-"], strict=True)) if a else ([], [])
    moved = True
    while moved:
        moved = False
        for s, t in ((x, y), (y, x)):
            for i in range(1, len(s)):
                if s[i] == "-" and s[i - 1] != "-" and t[i] == t[i - 1] == s[i - 1]:
                    s[i], s[i - 1] = s[i - 1], "-"
                    moved = True
    return "".join(x), "".join(y)


def edit_distance(a: str, b: str) -> int:
    return int(-aligned(a, b, "global", 0, -1, -1, -1)[0])


#: Pairs that edit_distances looks at at once, and letters up to which it takes them together.
AT_ONCE, TOGETHER = 4096, 128


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of many pairs of strings: the table of all pairs is filled cell by cell, pairs of longer strings one by one."""
    out = np.zeros(len(a), np.int32)
    n, m = (np.array([len(x) for x in k], np.int64) for k in (a, b))
    long = np.maximum(n, m) > TOGETHER
    for i in np.flatnonzero(long).tolist():
        out[i] = edit_distance(a[i], b[i])
    short = np.flatnonzero(~long)
    for k in range(0, len(short), AT_ONCE):
        at = short[k : k + AT_ONCE]
        x, y = (np.array([s[i] + "|" for i in at.tolist()]).view(np.uint32).reshape(len(at), -1).T.copy() for s in (a, b))
        row = [np.full(len(at), j, np.int16) for j in range(int(m[at].max()) + 1)]
        ends = np.stack(row)[m[at], np.arange(len(at))]
        done = np.where(n[at] == 0, ends, 0)
        for i in range(1, int(n[at].max()) + 1):
            new = [np.full(len(at), i, np.int16)]
            for j in range(1, len(row)):
                new.append(np.minimum(np.minimum(row[j], new[j - 1]) + np.int16(1), row[j - 1] + (x[i - 1] != y[j - 1])))
            row = new
            here = np.flatnonzero(n[at] == i)
            if len(here):
                done[here] = np.stack(row)[m[at][here], here]
        out[at] = done
    return out


RESULT = StructType([StructField("score", DoubleType()), StructField("a", StringType()), StructField("b", StringType()), *(StructField(k, IntegerType()) for k in ("si", "ei", "sj", "ej"))])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["score", "a", "b", "si", "ei", "sj", "ej"]).astype({k: "int32" for k in ("si", "ei", "sj", "ej")})


@F.pandas_udf(RESULT)
def local_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _frame([aligned(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(RESULT)
def global_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _frame([aligned(x or "", y or "", "global") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(RESULT)
def fixed_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _frame([aligned(x or "", y or "", "fixed") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def read_likelihood(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([log_likelihood(x or "", y or "", z)[0] for x, y, z in zip(a, b, p, strict=True)])
