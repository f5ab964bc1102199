"""Sums over all alignments of two sequences, many pairs at a time.

All of a is aligned with any part of b. An alignment is a way through the table of prefixes: it begins in the first row, where nothing is paid, and each step pairs a letter with
a letter, leaves out one of a or puts in one of b. The table is filled by anti-diagonals, so one step of numpy fills a diagonal of all pairs of a batch; pairs are
taken in order of length in bounded blocks, so padding stays small and memory does not depend on the batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Numbers that a diagonal of a block may have.
BLOCK = 1 << 18
RESULT = StructType([StructField(x, DoubleType()) for x in ("total", "best", "best_ways", "ways")])


def _letters(texts: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def _shifted(x: np.ndarray, fill: float) -> np.ndarray:
    out = np.empty_like(x)
    out[:, 0], out[:, 1:] = fill, x[:, :-1]
    return out


def _block(a: list[str], b: list[str], p: np.ndarray, band: int | None) -> np.ndarray:
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = int(n.max()) + 1
    x, y = _letters(a, width, -1), _letters(b, int(m.max()) + 1, -2)
    match, sub, ins, dele = (v[:, None] for v in (2 * np.log1p(-p), np.log(p * p / 3), np.log(p / 3), np.log(p)))
    i = np.arange(width)
    none = np.full((len(a), width), -np.inf)
    zero = np.zeros((len(a), width))
    # of the last two diagonals: log of the sum, maximum, ways to it, log of the number of ways
    one, two = (none, none, zero, none), (none, none, zero, none)
    result = [np.full(len(a), -np.inf), np.full(len(a), -np.inf), np.zeros(len(a)), np.full(len(a), -np.inf)]
    row = np.arange(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for d in range(width + int(m.max())):
            j = d - i
            inside = (j >= 0) & (j[None, :] <= m[:, None]) & (i[None, :] <= n[:, None])
            if band is not None:
                inside &= (j - i >= -band) & ((j - i)[None, :] <= np.maximum(m - n, 0)[:, None] + band)
            letter = np.where(i > 0, x[:, np.maximum(i - 1, 0)], -1) == np.where(j > 0, y[:, np.clip(j - 1, 0, y.shape[1] - 1)], -2)
            score = np.where(letter, match, sub)
            pair, left_out = [_shifted(v, w) for v, w in zip(two, (-np.inf, -np.inf, 0, -np.inf), strict=True)], [_shifted(v, w) for v, w in zip(one, (-np.inf, -np.inf, 0, -np.inf), strict=True)]
            total = np.logaddexp(np.logaddexp(pair[0] + score, left_out[0] + dele), one[0] + ins)
            ways = np.logaddexp(np.logaddexp(pair[3], left_out[3]), one[3])
            steps = (pair[1] + score, left_out[1] + dele, one[1] + ins)
            best = np.maximum(np.maximum(steps[0], steps[1]), steps[2])
            near = 1e-9 * np.maximum(1, np.abs(best))
            count = sum(np.where(s >= best - near, w, 0) for s, w in zip(steps, (pair[2], left_out[2], one[2]), strict=True))
            for v, start in ((total, 0.0), (best, 0.0), (count, 1.0), (ways, 0.0)):
                v[:, 0] = start
            now = (np.where(inside, total, -np.inf), np.where(inside, best, -np.inf), np.where(inside, count, 0), np.where(inside, ways, -np.inf))
            ends = [v[row, n] for v in now]
            higher, same = ends[1] > result[1] + 1e-9 * np.maximum(1, np.abs(ends[1])), np.abs(ends[1] - result[1]) <= 1e-9 * np.maximum(1, np.abs(ends[1]))
            result[2] = np.where(higher, ends[2], np.where(same, result[2] + ends[2], result[2]))
            result[1] = np.maximum(result[1], ends[1])
            result[0], result[3] = np.logaddexp(result[0], ends[0]), np.logaddexp(result[3], ends[3])
            one, two = now, one
    return np.stack(result, 1)


def sums(a: list[str], b: list[str], p: np.ndarray, band: int | None = None) -> np.ndarray:
    """Of each pair: ln of the sum of probabilities of all alignments, ln of the best one, the number of best ones, and ln of the number of all. p: error rate; a substitution has
    p * p / 3, an insertion p / 3, a deletion p, a match (1 - p) ** 2. band: only ways at most so far from the diagonals that lead from corner to corner."""
    out = np.zeros((len(a), 4))
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (len(a[order[to]]) + 1) <= BLOCK:
            to += 1
        own = order[at:to]
        out[own] = _block([a[k] for k in own], [b[k] for k in own], p[own], band)
        at = to
    return out


def alignment_sums(band: int | None = None):
    """A column function (a, b, p) of `sums`; null sequences count as empty."""

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(sums(a.fillna("").tolist(), b.fillna("").tolist(), p.to_numpy(float), band), columns=[f.name for f in RESULT.fields])

    return run
