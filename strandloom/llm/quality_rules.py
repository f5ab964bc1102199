"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

All signals are SQL expressions over whole texts, one pass, without a shuffle. Repeated
8-word windows: every word is hashed, every window's hash combines eight of them; only where some
window hash is not distinct are the positions sorted to count the words such windows cover.

Votes are one of good, bad or abstain for each rule. The corpus is reduced to counts of vote
patterns (3 to the number of rules at most, pre-aggregated), EM over these counts gives each
rule's accuracy (its rates of votes on good and on bad texts) and the share of good texts,
and the posterior becomes an expression over the votes: a sum of log-odds.

Null text counts as empty: no words, base_failed. Rows are judged one by one, so repeated rows and keys, null keys included, have each their
result. Other columns stay, whatever their names; those that a result has are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialised

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Posterior probability of being good from which a text is kept.
KEEP_FROM = 0.5
#: EM starts from this share of good texts and these rates of bad votes, abstentions and good votes, for good and for bad texts.
ROUNDS, START_GOOD, START = 60, 0.85, ((0.02, 0.28, 0.7), (0.4, 0.3, 0.3))
#: Votes of each kind that a rule has beforehand, and the bound that keeps both classes possible.
SMOOTH, MOST = 1.0, 0.995


def signals(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the columns of SIGNALS, all long."""
    text = F.coalesce(docs[column], F.lit(""))
    out = docs.withColumn("_w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("word_chars", (F.length(text) - F.length(F.regexp_replace(text, WORD, ""))).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    out = out.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    windows = f"""if(n_words < {WINDOW}, cast(array() as array<bigint>),
        transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({", ".join(f"_h[i + {k}]" for k in range(WINDOW))})))"""
    out = out.withColumn("_x", F.expr(windows)).withColumn("_many", F.size("_x") > F.size(F.array_distinct("_x")))
    out = out.withColumn("_s", F.expr("if(_many, array_sort(transform(_x, (h, i) -> struct(h, i))), null)"))
    out = out.withColumn("_p", F.expr("if(_many, array_sort(transform(filter(_s, (s, k) -> (k > 0 and _s[k - 1].h = s.h) or (k + 1 < size(_s) and _s[k + 1].h = s.h)), s -> s.i)), null)"))
    covered = f"if(_many, aggregate(transform(_p, (p, k) -> if(k + 1 < size(_p), least({WINDOW}, _p[k + 1] - p), {WINDOW})), 0L, (a, b) -> a + b), 0L)"
    return out.withColumn("n_repeat_words", F.expr(covered)).drop("_w", "_l", "_h", "_x", "_many", "_s", "_p")


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule when it votes bad and when good; else it abstains."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.col("word_chars")
    share = lambda c, k: F.col(c) * k
    text = F.col("_text")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    marks = F.regexp_count(text, F.lit(r"[!?#*$%&]{2,}|\|"))
    return {
        "length": (F.col("n_words") < 20, F.col("n_words") >= 60),
        "word_length": ((chars < 3 * n) | (chars > 12 * n), (chars >= 4 * n) & (chars <= 9 * n)),
        "symbols": (share("n_symbols", 10) > n, share("n_symbols", 50) <= n),
        "lines": (F.col("n_dup_lines") >= 3, F.col("n_dup_lines") == 0),
        "repeats": (share("n_repeat_words", 100) > 30 * n, share("n_repeat_words", 100) <= 5 * n),
        "capitals": (upper * 10 > letters * 4, upper * 10 <= letters),
        "marks": (marks * 20 > n, marks * 100 <= n),
    }


def vote(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with signals and a vote (1 good, -1 bad, 0 abstains) for each rule."""
    out = signals(docs, column).withColumn("_text", F.coalesce(F.col(column), F.lit("")))
    votes = {f"vote_{k}": F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in rules().items()}
    return out.withColumns(votes).drop("_text")


Votes = tuple[float, float, float]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[Votes, Votes]]]:
    """Share of good texts and, for each rule, how often it votes bad, abstains and votes good on good and on bad texts, by EM over pattern counts."""
    if not patterns:
        return START_GOOD, []
    width = len(patterns[0][0])
    good, rates = START_GOOD, [(START[0], START[1])] * width
    for _ in range(ROUNDS):
        hits = [([SMOOTH] * 3, [SMOOTH] * 3) for _ in range(width)]
        total = mass = 0.0
        for votes, count in patterns:
            p = posterior(votes, good, rates) * count
            mass, total = mass + p, total + count
            for k, v in enumerate(votes):
                hits[k][0][v + 1] += p
                hits[k][1][v + 1] += count - p
        good = min(MOST, max(1 - MOST, mass / total))
        rates = [tuple(tuple(x / sum(side) for x in side) for side in h) for h in hits]
        # no rule is worse than chance: a bad vote is never likelier on good texts, a good one never on bad texts
        rates = [(a, b) if a[0] <= b[0] and a[2] >= b[2] else ((x := tuple((p + q) / 2 for p, q in zip(a, b, strict=True))), x) for a, b in rates]
    return good, rates


def weight(v: int, rate: tuple[Votes, Votes]) -> float:
    """Log-odds for good that a vote, or abstaining, adds."""
    return math.log(rate[0][v + 1] / rate[1][v + 1])


def posterior(votes: tuple[int, ...], good: float, rates: list[tuple[Votes, Votes]]) -> float:
    x = math.log(good / (1 - good)) + sum(weight(v, a) for v, a in zip(votes, rates, strict=True))
    return 1 / (1 + math.exp(-max(-500, min(500, x))))


def judge(docs: DataFrame, column: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with signals, votes, base_failed, quality (posterior) and kept. Votes are needed twice, for the rates and for the
    result: without keep_text they are materialised, else the second pass computes them again."""
    names = [f"vote_{k}" for k in rules()]
    mine = {*SIGNALS, *names, "quality", "base_failed", "kept"} | (set() if keep_text else {column})
    others = [n for n in docs.columns if n not in mine]
    rows = docs.select(F.struct(*(docs[n] for n in others or [column])).alias("row"), docs[column].alias("text"))
    voted = vote(rows, "text") if keep_text else materialised(vote(rows, "text").drop("text"))
    counts = voted.groupBy(*names).count().collect()  # 3 ** len(names) rows at most
    good, rates = estimate(sorted((tuple(r[:-1]), r[-1]) for r in counts))
    odds = F.lit(math.log(good / (1 - good)))
    for name, rate in zip(names, rates or [START] * len(names), strict=True):
        odds = odds + F.when(F.col(name) > 0, weight(1, rate)).when(F.col(name) < 0, weight(-1, rate)).otherwise(weight(0, rate))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
    return out.select(*(F.col("row")[n].alias(n) for n in others), *SIGNALS, *names, "quality", "base_failed", "kept")
