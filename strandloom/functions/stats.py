"""Exact two-sided binomial test and small statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..schemas import ALPHA

_log_factorial = np.zeros(1)


def log_factorial(n: int) -> np.ndarray:
    """ln k! for k up to n at least; grown as needed."""
    global _log_factorial
    if len(_log_factorial) <= n:
        size = max(n + 1, 2 * len(_log_factorial))
        _log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size)))])
    return _log_factorial


def binomial_p(x: float, n: float, p: float) -> float:
    """Sum of the probabilities that are not larger (but for 1e-7) than that of x."""
    x, n = int(round(x)), int(round(n))
    if n <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return 1.0 if x == (0 if p <= 0 else n) else 0.0
    f = log_factorial(n)
    k = np.arange(n + 1)
    pmf = f[n] - f[k] - f[n - k] + k * np.log(p) + (n - k) * np.log1p(-p)
    return float(min(1.0, np.exp(pmf[pmf <= pmf[x] + np.log1p(1e-7)]).sum()))


@F.pandas_udf(DoubleType())
def binomial_test(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_p(a, b, q) for a, b, q in zip(x, n, p, strict=True)])


def group_count_test(totals: list[float], lengths: list[int], alpha: float = ALPHA, stop: float = 1_000_000) -> list[int]:
    """Marks (1: boundary) behind each segment but the last: neighbouring groups are merged until all boundaries that are
    left are significant. A group's counts are added up only until stop."""
    marks = [1] * max(0, len(totals) - 1)
    while True:
        groups: list[list[float]] = []
        for i, (t, n) in enumerate(zip(totals, lengths, strict=True)):
            if i == 0 or marks[i - 1]:
                groups.append([0.0, 0.0])
            if groups[-1][0] <= stop:
                groups[-1][0] += t
                groups[-1][1] += n
        at = [i for i, m in enumerate(marks) if m]
        new = list(marks)
        for k, i in enumerate(at):
            (a, n), (b, m) = groups[k], groups[k + 1]
            if binomial_p(a, a + b, n / (n + m) if n + m else 0.5) >= alpha:
                new[i] = 0
        if new == marks:
            return marks
        marks = new


def grouping(totals: list[float], lengths: list[int], marks: list[int]) -> list[tuple[float, int]]:
    """(sum, length) of each group that marks leave."""
    out: list[list[float]] = []
    for i, (t, n) in enumerate(zip(totals, lengths, strict=True)):
        if i == 0 or marks[i - 1]:
            out.append([0, 0])
        out[-1][0] += t
        out[-1][1] += n
    return [(a, b) for a, b in out]


def precision_recall(hits: int, found: int, truth: int) -> tuple[float, float, float]:
    """Precision (1 if nothing was found), recall (1 if nothing is true) and F1."""
    p = hits / found if found else 1.0
    r = hits / truth if truth else 1.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0
