"""Which ins of a repeat go with which outs: expectation-maximisation over pairs, and the best two matchings.

Each pair (l, r) of a repeat is a template; reads come from templates in unknown shares. All repeats are fitted at once: a round gives each read soft shares in the templates of its
repeat, then the templates their shares of the bases; repeats whose likelihood stands still leave the table. The bases that a pair has in the end are its score, and the matching of
most bases wins if it has clearly more than the next one. Both matchings are exact for any number of ins and outs: the best assignment, and the best of those that differ from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import fixed_alignment
from ..plans.runtime import materialised

c = F.col
#: Error rate, letters of a contig beside the repeat, ratio at which a matching is accepted.
ERROR, FLANK, ACCEPT = 0.01, 20_000, 1.001
#: Change of the log likelihood, relative, below which a repeat is done; shares below LEAST are 0. Rounds of one job, after which that is looked at.
STILL, LEAST, STEPS = 1e-6, 1e-12, 4
PAIR = ["rep_id", "l", "r"]


def every_pair(repeats: DataFrame) -> DataFrame:
    """(rep_id, l, r): all ins with all outs of repeats (rep_id, ins, outs) that have as many of each."""
    even = repeats.where(F.size("ins") == F.size("outs"))
    return even.select("rep_id", F.explode("ins").alias("l"), "outs").select("rep_id", "l", F.explode("outs").alias("r"))


def pair_templates(pairs: DataFrame, sides: DataFrame, middles: DataFrame, flank: int = FLANK) -> DataFrame:
    """(rep_id, l, r, seq): end of l, what lies between, begin of r, once a pair whatever the number of matchings. sides (id, seq); middles (l, r, middle) or
    (l, r, start, middle), start: letters of r that the overlap takes."""
    left, right = sides.select(c("id").alias("l"), F.right("seq", F.lit(flank)).alias("sl")), sides.select(c("id").alias("r"), c("seq").alias("sr"))
    start = c("start") if "start" in middles.columns else F.lit(0)
    rows = pairs.join(left, "l").join(right, "r").join(middles, ["l", "r"])
    return rows.select(*PAIR, F.concat("sl", "middle", F.substr("sr", start + 1, F.lit(flank))).alias("seq"))


def read_scores(templates: DataFrame, reads: DataFrame, q: float = ERROR) -> DataFrame:
    """(rep_id, l, r, read, bases, ll): log likelihood of each read (rep_id, read, seq) under each template of its repeat, by the edits of its best place there."""
    both = templates.join(reads.withColumnRenamed("seq", "s"), "rep_id").withColumn("a", fixed_alignment("s", "seq"))
    n = F.length("s")
    # the score is letters that agree less edits, so half of n - score counts substitutions and deletions whole and insertions half
    edits = (n - c("a.score")) / 2
    return both.select(*PAIR, "read", n.alias("bases"), (edits * F.ln(F.lit(q)) + (n - edits) * F.ln(F.lit(1 - q))).alias("ll"))


def even_shares(scores: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """(rep_id, l, r, share) to begin with: by the depths (id, depth) of both sides, or all alike."""
    pairs = scores.select(*PAIR).distinct()
    if depth is None:
        pairs = pairs.withColumn("w", F.lit(1.0))
    else:
        pairs = pairs.join(depth.select(c("id").alias("l"), c("depth").alias("dl")), "l").join(depth.select(c("id").alias("r"), c("depth").alias("dr")), "r").withColumn("w", (c("dl") + c("dr")).cast("double"))
    total = F.sum("w").over(Window.partitionBy("rep_id"))
    return pairs.select(*PAIR, F.when(total > 0, c("w") / total).otherwise(0.0).alias("share"))


def em_round(scores: DataFrame, shares: DataFrame) -> DataFrame:
    """(rep_id, l, r, weight, share, ll): bases and share of each pair after one round, and the log likelihood of its repeat before it. Reads count by their bases in both, so no round lowers
    the likelihood."""
    own = Window.partitionBy("rep_id", "read")
    x = c("ll") + F.ln("share")
    rows = scores.join(shares.where(c("share") > LEAST), PAIR).withColumn("x", x).withColumn("m", F.max(x).over(own))
    rows = rows.withColumn("e", F.exp(c("x") - c("m"))).withColumn("s", F.sum("e").over(own)).withColumn("first", F.row_number().over(own.orderBy("l", "r")))
    told = rows.groupBy(*PAIR).agg(F.sum(c("bases") * c("e") / c("s")).alias("weight"), F.sum(F.when(c("first") == 1, c("bases") * (c("m") + F.ln("s"))).otherwise(0.0)).alias("ll"))
    of = Window.partitionBy("rep_id")
    return told.select(*PAIR, "weight", (c("weight") / F.sum("weight").over(of)).alias("share"), F.sum("ll").over(of).alias("ll"))


def added_up(scores: DataFrame) -> DataFrame:
    """scores with reads of a repeat that say the same (the same ll under the same pairs, bases in the same proportion) as one read of all their bases. Rounds give
    them the same shares and count them by their bases, so nothing changes by it; reads get new numbers."""
    each = scores.select(*PAIR, "read", c("bases").cast("double").alias("bases"), "ll").dropna(subset=PAIR)
    rows = each.repartition("rep_id", "read").groupBy("rep_id", "read").agg(F.sort_array(F.collect_list(F.struct("l", "r", "ll", "bases"))).alias("v"))
    first = c("v")[0]["bases"]
    rows = rows.withColumn("w", F.when(first > 0, first).otherwise(1.0))
    rows = rows.select("rep_id", "w", F.transform("v", lambda e: F.struct(e["l"].alias("l"), e["r"].alias("r"), e["ll"].alias("ll"), (e["bases"] / c("w")).alias("f"))).alias("v"))
    rows = rows.groupBy("rep_id", "v").agg(F.sum("w").alias("w")).withColumn("read", F.monotonically_increasing_id())
    return rows.select("rep_id", "read", "w", F.inline("v")).select(*PAIR, "read", (c("w") * c("f")).alias("bases"), "ll")


def fitted(scores: DataFrame, shares: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(rep_id, l, r, weight, share, ll, rounds): pairs when their repeat's likelihood stands still, or after just so many rounds. Pairs that no read supports are gone."""
    scores = materialised(added_up(scores))
    now = materialised(shares if shares is not None else even_shares(scores))
    done, last, k = None, None, 0
    while True:
        own, new = scores.join(now.select("rep_id").distinct(), "rep_id", "left_semi"), now
        steps = STEPS if rounds is None else min(STEPS, rounds - k)
        for _ in range(steps):
            new = em_round(own, new.select(*PAIR, "share"))
        k += steps
        new = new.withColumn("rounds", F.lit(k))
        if last is not None:
            new = new.join(last, "rep_id", "left").withColumn("still", F.coalesce(F.abs(c("ll") - c("before")) <= STILL * F.greatest(F.lit(1.0), F.abs(c("ll"))), F.lit(False)))
        else:
            new = new.withColumn("before", F.lit(None).cast("double")).withColumn("still", F.lit(False))
        if rounds is not None:
            new = new.withColumn("still", F.lit(k >= rounds))
        new = materialised(new)
        out = new.where("still").select(*PAIR, "weight", "share", "ll", "rounds")
        done = out if done is None else done.union(out)
        now = new.where("not still").select(*PAIR, "share")
        last = new.where("not still").select("rep_id", c("ll").alias("before")).distinct()
        if not now.limit(1).count():
            return done


def assignment(cost: np.ndarray) -> tuple[float, np.ndarray]:
    """The cheapest assignment of rows to columns (infinite costs: forbidden) by shortest augmenting paths; infinite if there is none."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.full(n + 1, n)
    for i in range(n):
        match[n] = i
        col, least, way, used = n, np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, bool)
        while match[col] != n:
            used[col] = True
            row = match[col]
            reduced = np.where(used[:n], np.inf, cost[row] - u[row] - v[:n])
            better = reduced < least[:n]
            least[:n][better], way[:n][better] = reduced[better], col
            free = np.where(used[:n], np.inf, least[:n])
            to = int(free.argmin())
            if not np.isfinite(free[to]):
                return np.inf, match[:n]
            step = free[to]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = to
        while col != n:
            match[col] = match[way[col]]
            col = way[col]
    out = np.zeros(n, int)
    out[match[:n]] = np.arange(n)
    return float(cost[np.arange(n), out].sum()), out


def best_two(cost: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """The cheapest assignment and the cheapest other one (if any): of those that keep its first i rows and change the next, for each i."""
    best = assignment(cost)
    if not np.isfinite(best[0]):
        return []
    second: tuple[float, np.ndarray] | None = None
    for i in range(len(cost)):
        part = cost.copy()
        for j in range(i):
            keep = part[j, best[1][j]]
            part[j, :] = np.inf
            part[:, best[1][j]] = np.inf
            part[j, best[1][j]] = keep
        part[i, best[1][i]] = np.inf
        other = assignment(part)
        if np.isfinite(other[0]) and (second is None or other[0] < second[0]):
            second = other
    return [best] + ([second] if second else [])


def _matched(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (rep_id, l, r, weight) sorted by repeat: the best two matchings of each."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, left, right, weight = (pdf[x].to_numpy() for x in ("rep_id", "l", "r", "weight"))
        edge = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1], [True]]))
        rows: list[tuple] = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            ins, outs = np.unique(left[a:b]), np.unique(right[a:b])
            if len(ins) == len(outs):
                cost = np.full((len(ins), len(outs)), np.inf)
                cost[np.searchsorted(ins, left[a:b]), np.searchsorted(outs, right[a:b])] = -weight[a:b]
                for rank, (total, to) in enumerate(best_two(cost)):
                    rows += [(rep[a], rank, -total, ins[i], outs[j]) for i, j in enumerate(to.tolist())]
        return pd.DataFrame(rows, columns=["rep_id", "rank", "score", "l", "r"])

    held = None
    for pdf in pdfs:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(held):
            # the last repeat may go on in the next batch
            last = held["rep_id"].to_numpy() == held["rep_id"].iloc[-1]
            if not last.all():
                yield done(held[~last])
                held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield done(held)


def best_matchings(weights: DataFrame) -> DataFrame:
    """(rep_id, rank, score, l, r): the matchings of most weight and second most (rank 0 and 1), exact at any size. weights (rep_id, l, r, weight): pairs that may be matched, finite."""
    rows = weights.select("rep_id", "l", "r", c("weight").cast("double").alias("weight")).repartition("rep_id").sortWithinPartitions("rep_id")
    return rows.mapInPandas(_matched, "rep_id long, rank int, score double, l long, r long")


def decided(matchings: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(rep_id, l, r) of the best matchings that have more than `accept` times the score of the second, or no second."""
    score = matchings.groupBy("rep_id").agg(F.max(F.when(c("rank") == 0, c("score"))).alias("a"), F.max(F.when(c("rank") == 1, c("score"))).alias("b"))
    sure = score.where(c("b").isNull() | (c("a") > accept * c("b"))).select("rep_id")
    return matchings.where("rank = 0").join(sure, "rep_id").select("rep_id", "l", "r")


def resolve_by_em(repeats: DataFrame, sides: DataFrame, middles: DataFrame, reads: DataFrame, depth: DataFrame | None = None, accept: float = ACCEPT) -> DataFrame:
    """(rep_id, l, r): pairs of repeats (rep_id, ins, outs) that reads (rep_id, read, seq) decide. Contigs are templates as far as the longest read reaches."""
    pairs = materialised(every_pair(repeats))
    flank = min(FLANK, reads.agg(F.max(F.length("seq"))).first()[0] or 0)
    scores = materialised(read_scores(pair_templates(pairs, sides, middles, flank), reads))
    fit = fitted(scores, even_shares(scores, depth))
    weights = pairs.join(fit.select(*PAIR, "weight"), PAIR, "left").select(*PAIR, F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return decided(best_matchings(weights), accept)
