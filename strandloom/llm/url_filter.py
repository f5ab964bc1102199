"""URL filters: rules on host and path, and gradient-boosted trees on lexical features where no rule applies.

Rules are matched by looking up every suffix of the host and every rule path by an expression; the
longest rule wins. All features, bins and scores are SQL expressions; a model is a sum of nested WHENs.
Training: features of a bounded sample of labelled URLs (SAMPLE, a fixed choice by hash) are binned in Spark; trees are grown on the driver
from sums over these bins. Suffix statistics are the shares of bad URLs by host suffix in that sample.

A url is null or has no "://": host and path are empty, no rule applies and the model judges the empty text. Ties between
rules of equal length go to the one that is later in code-point order. Rows are judged one by one, so repeated rows and keys, null keys included,
have each their result. Other columns stay, whatever their names; those of RESULT are replaced.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, RATE, LEAST_LEAF, BINS, PART = 24, 3, 0.3, 3, 16, 0.5
BLOCK_FROM = 0.5
RESULT = ("host", "path", "rule", "bad", "verdict")
#: Words of hosts that label a URL as bad where no list of labelled URLs is given.
BAD_WORDS = ("spam", "pills", "casino", "ads", "track", "win", "free", "xxx", "porn", "bet", "loan", "viagra", "malware", "phish", "adult", "bets")
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-."


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest of rules (verdict, host, path) that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers from the text of a URL."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    long = F.greatest(F.length(text), F.lit(1))
    size = F.greatest(F.length(host), F.lit(1))
    share = [(F.length(host) - F.length(F.replace(host, F.lit(c), F.lit("")))) / size for c in ALPHABET]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share[1:]), F.when(share[0] > 0, -share[0] * F.log2(share[0])).otherwise(0.0))
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": count(path, "/[^/]+"),
        "digit_ratio": count(text, "[0-9]") / long,
        "entropy": F.round(entropy, 9),  # equal for the same letters in any order
        "parameters": count(query, "[^&]+"),
        "hyphens": count(host, "-"),
        "labels": count(host, r"[^.]+"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))).cast("double"),
    }


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def labelled_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Labelled URLs (url, bad) from a word list: hosts that have one of BAD_WORDS as a part of a label are bad."""
    host, _ = split_url(F.col(url))
    bad = host.rlike(r"(^|[.-])(" + "|".join(BAD_WORDS) + r")([.-]|$)")
    return pages.where(F.contains(F.col(url), F.lit("://"))).select(F.col(url).alias("url"), bad.cast("int").alias("bad"))


def _cuts(values: list[float]) -> list[float]:
    """Where bins begin, at equal steps through the distinct values, so that rare ones have a bin too."""
    each = sorted(set(values))
    return each[1:] if len(each) <= BINS else [each[len(each) * (k + 1) // BINS] for k in range(BINS - 1)]


def grow(bins: list[list[int]], residual: list[float], hessian: list[float], rows: list[int], depth: int, features: Sequence[int], mass: list[float], least: float) -> dict:
    """A tree on rows of some binned features: {feature, bin, left, right} sends rows with bin < that to the left; or {value}. Each side of a split has the
    least mass or more."""
    g, h = sum(residual[i] for i in rows), sum(hessian[i] for i in rows)
    best = (1e-6, None)
    for f in features if depth else ():
        column = bins[f]
        sums: dict[int, list[float]] = {}
        for i in rows:
            s = sums.setdefault(column[i], [0.0, 0.0, 0])
            s[0] += residual[i]
            s[1] += hessian[i]
            s[2] += mass[i]
        whole = sum(s[2] for s in sums.values())
        a = b = n = 0.0
        order = sorted(sums)
        for k in order[:-1]:
            a, b, n = a + sums[k][0], b + sums[k][1], n + sums[k][2]
            if min(n, whole - n) >= least - 1e-6:
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, k + 1))
    if best[1] is None:
        return {"value": RATE * g / (h + 1)}
    f, k = best[1]
    left = [i for i in rows if bins[f][i] < k]
    right = [i for i in rows if bins[f][i] >= k]
    return {"feature": f, "bin": k, "left": grow(bins, residual, hessian, left, depth - 1, features, mass, least), "right": grow(bins, residual, hessian, right, depth - 1, features, mass, least)}


def boost(bins: list[list[int]], bad: list[int], mass: list[float] | None = None) -> tuple[float, list[dict]]:
    """Start and trees of a logistic model of rows with a mass each (the weight is mass by its mean). Each tree sees a fixed choice of PART of the features, so that of features that tell the sample apart
    equally well none decides alone."""
    n = len(bad)
    mass = [1.0] * n if mass is None else mass
    w = [x * n / sum(mass) for x in mass]
    of_bad = sum(x for x, y in zip(mass, bad, strict=True) if y)
    least = min(LEAST_LEAF, max(1.0, min(of_bad, sum(mass) - of_bad)))  # less where a class has less
    mean = min(0.99, max(0.01, (sum(x * y for x, y in zip(w, bad, strict=True)) + 0.5) / (sum(w) + 1)))
    rng = random.Random(17)
    start = math.log(mean / (1 - mean))
    score, trees = [start] * n, []

    def value(tree: dict, i: int) -> float:
        while "value" not in tree:
            tree = tree["left"] if bins[tree["feature"]][i] < tree["bin"] else tree["right"]
        return tree["value"]

    for _ in range(TREES if n else 0):
        p = [1 / (1 + math.exp(-x)) for x in score]
        some = sorted(rng.sample(range(len(bins)), max(1, round(PART * len(bins)))))
        tree = grow(bins, [x * (y - q) for x, y, q in zip(w, bad, p, strict=True)], [x * q * (1 - q) for x, q in zip(w, p, strict=True)], list(range(n)), DEPTH, some, mass, least)
        trees.append(tree)
        score = [x + value(tree, i) for i, x in enumerate(score)]
    return start, trees


def expression(tree: dict, columns: list[Column], cuts: list[list[float]]) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    test = columns[tree["feature"]] < cuts[tree["feature"]][tree["bin"] - 1]
    return F.when(test, expression(tree["left"], columns, cuts)).otherwise(expression(tree["right"], columns, cuts))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule (its host and path, or null), bad (the model's probability) and verdict (the rule's, else the model's)."""
    spark = pages.sparkSession
    labelled = labelled_urls(pages, url) if labelled is None else labelled
    sample = labelled.where("url is not null and bad is not null").orderBy(F.xxhash64("url", F.lit(3)), "url").limit(SAMPLE)
    host, path = split_url(F.col("url"))
    sample = sample.withColumn("host", host).withColumn("path", path)
    numbers = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = sample.select("bad", "host", suffix(F.col("host")).alias("suffix"), *(c.alias(k) for k, c in numbers.items())).collect()
    sums: dict[str, list[int]] = {}
    for r in rows:
        s = sums.setdefault(r["suffix"], [0, 0])
        s[0] += r["bad"]
        s[1] += 1
    base = (sum(r["bad"] for r in rows) + 1) / (len(rows) + 2)
    shares = {k: (a + 10 * base) / (n + 10) for k, (a, n) in sums.items()}
    values = [[r[k] for r in rows] for k in numbers] + [[shares[r["suffix"]] for r in rows]]
    cuts = [_cuts(v) for v in values]
    binned = [[sum(x >= c for c in cut) for x in v] for v, cut in zip(values, cuts, strict=True)]
    # a host counts as much as another one, however many URLs of it there are, and no leaf is for one host
    urls = Counter(r["host"] for r in rows)
    start, trees = boost(binned, [int(r["bad"]) for r in rows], [1 / urls[r["host"]] for r in rows])
    known = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"s": k, "v": v} for k, v in sorted(shares.items())])), "array<struct<s: string, v: double>>")).alias("p")).select(F.col("p.s").alias("_s"), F.col("p.v").alias("_share"))
    others = [n for n in pages.columns if n not in RESULT]
    host, path = split_url(F.col("url"))
    out = pages.select(F.struct(*(pages[n] for n in pages.columns)).alias("row"), pages[url].alias("url")).withColumn("host", host).withColumn("path", path)
    numbers = lexical(F.col("url"), F.col("host"), F.col("path"))
    out = out.withColumns({f"_{k}": c for k, c in numbers.items()}).withColumn("_suffix", suffix(F.col("host")))
    out = out.join(known, F.col("_suffix") == F.col("_s"), "left")  # one row per suffix of the bounded sample
    columns = [F.col(f"_{k}") for k in numbers] + [F.coalesce("_share", F.lit(base))]
    score = sum((expression(t, columns, cuts) for t in trees), F.lit(start))
    out = out.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("bad", 1 / (1 + F.exp(-score)))
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad") >= BLOCK_FROM, "block").otherwise("allow"))
    return out.select(*(F.col("row")[n].alias(n) for n in others), "host", "path", F.col("fit.rule").alias("rule"), "bad", verdict.alias("verdict"))
