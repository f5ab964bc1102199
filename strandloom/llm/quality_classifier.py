"""Quality classifier by positive-unlabelled learning.

A linear model on features of whole texts minimises the non-negative unbiased risk: with class prior p,
risk = p * loss of positives as good + max(0, loss of unlabelled as bad - p * loss of positives as bad).
Positives are trusted rows labelled good; unlabelled rows are web text of any kind, rows without a label (all rows
that may be trained on, if each has one). Labels of bad rows are not used at all. The prior, the share of good rows among unlabelled
ones, is estimated from these two samples: a model fitted on half of each ranks the other halves, and where its best scores hold
a share p of the positives and u of the unlabelled, the prior is u / p at most; the least such bound counts, less reliable ones being
those with few rows. Each sample is bounded (SAMPLE), a fixed choice by hash, and is
all that reaches the driver; scoring is one pass over all texts without a shuffle.

Features never use keys, labels, language or source: shares of character classes, hashed pairs of bytes, word
lengths, and how much of words, five-word sequences and lines repeats.

Null and empty texts get the score of a text without features. Rows without a key are never held out. Labels that are null, or of
keys that are absent, are ignored. Of rows that share a key one is trained on, the least text; each is scored by its own text.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, map_batches, materialised, mix, randoms, slice_hashes, small_batches, text_slices, words

#: Rows of each kind, at most, that are fitted on.
SAMPLE = 6000
PAIRS = 256
STYLE = 20
STEPS, RATE, DECAY = 400, 0.05, 3e-3
#: Chance of an error beyond what the prior's estimate allows for.
DOUBT = 0.1
THRESHOLD = 0.7
UPPER, LOWER, DIGIT, BLANK, NEWLINE, STOP, LOUD, PIPE, SYMBOL, HIGH, REST = range(11)
KIND = np.full(256, REST, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = UPPER, LOWER, DIGIT, HIGH
KIND[[9, 11, 12, 13, 32]], KIND[10], KIND[124] = BLANK, NEWLINE, PIPE
for _chars, _k in ((b".,;:", STOP), (b"!?", LOUD), (b"#*$%&<>@^~_=+{}[]\\/", SYMBOL)):
    KIND[list(_chars)] = _k
MIX = randoms(8, 31) | U64(1)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row behind, matrix) of consecutive rows."""
    for row, to, buf, offsets in text_slices(column):
        n, size = to - row, np.diff(offsets)
        out = np.zeros((n, STYLE + PAIRS), np.float32)
        of = np.repeat(np.arange(n, dtype=np.int32), size)
        kind = KIND[buf]
        accent = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E))
        kind[accent], kind[accent + 1] = REST, UPPER
        count = np.bincount(of * 11 + kind, minlength=11 * n).reshape(n, 11)
        total = np.maximum(size, 1)
        out[:, :11] = count / total[:, None]
        letters = np.maximum(count[:, UPPER] + count[:, LOWER] + count[:, HIGH], 1)
        out[:, 11] = count[:, UPPER] / letters
        s, e, first = words(buf, offsets)
        w, many = slice_hashes(buf, s, e), np.diff(first)
        total_words = np.maximum(many, 1)
        out[:, 12] = np.log1p(many) / 10
        out[:, 13] = (np.concatenate([[0], np.cumsum(e - s)])[first[1:]] - np.concatenate([[0], np.cumsum(e - s)])[first[:-1]]) / total_words / 10
        five = np.zeros(max(0, len(w) - 4), U64)
        for k in range(5):
            five += mix(w[k : k + len(five)] * MIX[k])
        breaks = np.flatnonzero(buf == 10)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        starts = starts[starts < len(buf)]
        line = slice_hashes(buf, starts, np.append(starts[1:], len(buf)))
        line_at = np.searchsorted(starts, offsets)
        for i, (a, b, c, d) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), line_at[:-1].tolist(), line_at[1:].tolist(), strict=True)):
            if b > a:
                out[i, 14] = 1 - len(np.unique(w[a:b])) / (b - a)
            if b > a + 4:
                out[i, 15] = 1 - len(np.unique(five[a : b - 4])) / (b - 4 - a)
            if d > c:
                out[i, 16] = 1 - len(np.unique(line[c:d])) / (d - c)
        out[:, 17] = many < 20
        out[:, 18] = 1
        out[:, 19] = count[:, NEWLINE] / total_words
        pair = ((buf[:-1].astype(np.uint32) * 0x9E37 + buf[1:].astype(np.uint32) * 0x85EB) >> 5) & (PAIRS - 1)
        same = of[:-1] == of[1:]
        pairs = np.bincount(of[:-1][same] * PAIRS + pair[same], minlength=PAIRS * n).reshape(n, PAIRS)
        out[:, STYLE:] = np.sqrt(pairs / total[:, None])
        yield row, to, out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, x in features(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), pa.array([v.tobytes() for v in x], pa.binary())], names=["good", "x"])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, and mean and scale of features, at the least non-negative unbiased logistic risk (Adam on whole samples)."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0)
    constant = scale < 1e-6
    mean[constant], scale[constant] = 0, 1
    p, u = ((np.clip((x - mean) / scale, -8, 8)).astype(np.float64) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, STEPS + 1):
        zp, zu = p @ w, u @ w
        good = -prior * (p.T @ sigmoid(-zp)) / len(p)
        bad = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = good + bad if risk >= 0 else -bad  # a negative part is walked back
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, mean, scale


def scores(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, mean, scale = model
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float64) @ w
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good rows among unlabelled ones, from scores of positives and unlabelled rows that no model was fitted on: the least ratio of
    the shares of both above a score, where an error of either share (with a chance of DOUBT) makes a ratio worse."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    cut = np.unique(p)
    above = lambda x: 1 - np.searchsorted(x, cut, "left") / len(x)
    share_p, share_u = above(p), above(u)
    error = np.sqrt(np.log(4 / DOUBT) / 2 / len(p)) + np.sqrt(np.log(4 / DOUBT) / 2 / len(u))
    best = int(np.argmin((share_u + error) / share_p))
    return float(min(0.99, max(0.01, share_u[best] / share_p[best])))


def fit_with_prior(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """The model, and the prior that it was fitted with."""
    half = fit(positive[::2], unlabelled[::2], 0.5)
    prior = class_prior(scores(positive[1::2], half), scores(unlabelled[1::2], half))
    return fit(positive, unlabelled, prior), prior


def held_out(key) -> object:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights, and mean and scale of features; None if no document that may be trained on is labelled 1, or there is none besides."""
    usable = docs.select(docs[key].alias("k"), docs[column].alias("text")).where(~held_out(F.col("k")))
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("good")).where(~held_out(F.col("k"))).where("k is not null and good is not null")
    order = F.xxhash64("k", F.lit(5))
    chosen = known.where("good = 1").select("k").distinct().orderBy(order, "k").limit(SAMPLE).withColumn("good", F.lit(1))
    free = usable.where("k is not null").select("k").join(known.select("k").distinct(), "k", "left_anti")
    other = free.distinct().orderBy(F.xxhash64("k", F.lit(6)), "k").limit(SAMPLE)
    pairs = materialised(chosen.unionByName(other.withColumn("good", F.lit(0))), 1)
    if not pairs.where("good = 0").limit(1).count():  # every row has a label
        pairs = pairs.unionByName(usable.where("k is not null").select("k").distinct().orderBy(F.xxhash64("k", F.lit(6)), "k").limit(SAMPLE).withColumn("good", F.lit(0)))
    texts = pairs.join(usable, "k").groupBy("good", "k").agg(F.min("text").alias("text")).orderBy("good", "k")
    rows = map_batches(texts.select("good", "text"), _extract, "good int, x binary").collect()
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.float32).reshape(len(rows), STYLE + PAIRS)
    good = np.array([r[0] for r in rows], bool)
    if not good.any() or good.all():
        return None
    return fit_with_prior(x[good], x[~good])[0]


def _score(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), batch.column(1).slice(row, to - row), pa.array(scores(x, model))], names=["rest", "text", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "quality") -> DataFrame:
    """docs with held_out, score (0 to 1, higher is likelier good) and predicted (1 from THRESHOLD). Without any usable positive label there
    is no model: every score is 0.5 and predicted is null, with a warning."""
    names = [n for n in docs.columns if n not in ("held_out", "score", "predicted")]
    small_batches(docs.sparkSession)
    model = train(docs, labels, key, column, label)
    trained = model is not None
    if not trained:
        warnings.warn("no usable document is labelled 1: nothing is predicted", stacklevel=2)
        model = np.zeros(STYLE + PAIRS), np.zeros(STYLE + PAIRS), np.ones(STYLE + PAIRS)
    rows = docs.select(F.struct(*(docs[n] for n in names if n != column)).alias("rest"), docs[column].alias("text"))
    out = map_batches(rows, _score(model), rows.withColumn("score", F.lit(0.0)).schema)
    out = out.select(*(F.col("text").alias(n) if n == column else F.col("rest")[n].alias(n) for n in names), "score")
    return out.withColumn("held_out", held_out(F.col(key))).withColumn("predicted", F.when(F.lit(trained), (F.col("score") >= THRESHOLD).cast("int")))
