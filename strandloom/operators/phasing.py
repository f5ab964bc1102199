"""Phasing, consensus and copy numbers: maximum likelihood over matchings, votes, single-base differences, tandem repeats."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import global_alignment, read_likelihood
from ..functions.sequence import beside_run
from ..plans.runtime import materialised
from .aggregates import mixing_shares, votes
from .contraction import cycles

c = F.col
#: Error rate, prior of a difference, bin of templates, thresholds of votes.
ERROR, PRIOR, BIN, FLANK, ACCEPT = 0.01, 0.01, 50, 20_000, 1.001
DELETE, INSERT, SUBSTITUTE, LEAST = 0.5, 0.4, 0.4, 4
LONG, REPEATED = 15_000, 10


def matchings(repeats: DataFrame, most: int = 7) -> DataFrame:
    """(rep_id, matching, l, r): every way to pair ins with outs one to one. Repeats with more than `most` of a side have factorially
    many and are left out; em.best_matchings has the best two of those at any size."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rep, ins, outs in pdf.itertuples(index=False, name=None):
                if len(ins) == len(outs) <= most:
                    rows += [(rep, m, int(a), int(b)) for m, p in enumerate(permutations(sorted(outs))) for a, b in zip(sorted(ins), p, strict=True)]
            yield pd.DataFrame(rows, columns=["rep_id", "matching", "l", "r"])

    return repeats.select("rep_id", "ins", "outs").mapInPandas(run, "rep_id long, matching int, l long, r long")


def templates(pairs: DataFrame, sides: DataFrame, middles: DataFrame, flank: int = FLANK) -> DataFrame:
    """(rep_id, matching, l, r, seq): end of l, what lies between, begin of r. sides (id, seq), middles (l, r, middle)."""
    s = lambda k, out: sides.select(c("id").alias(k), c("seq").alias(out))
    rows = pairs.join(s("l", "sl"), "l").join(s("r", "sr"), "r").join(middles, ["l", "r"])
    return rows.select("rep_id", "matching", "l", "r", F.concat(F.right("sl", F.lit(flank)), "middle", F.left("sr", F.lit(flank))).alias("seq"))


def read_association(temps: DataFrame, reads: DataFrame) -> DataFrame:
    """(rep_id, matching, l, r, read, d): each read's nearest template of a matching by edit distance of its best part; ties by hash.
    reads (rep_id, read, seq)."""
    from ..functions.alignment import fixed_alignment

    both = temps.join(reads.withColumnRenamed("seq", "q"), "rep_id").withColumn("a", fixed_alignment("q", "seq"))
    both = both.select("rep_id", "matching", "l", "r", "read", (F.length("q") - c("a.score")).alias("d"), F.length("q").alias("bases"))
    w = Window.partitionBy("rep_id", "matching", "read").orderBy("d", F.xxhash64("read", "l", "r"), "l", "r")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def matching_scores(assoc: DataFrame, depth: DataFrame, q: float = ERROR) -> DataFrame:
    """(rep_id, matching, score): ln likelihood of edits at rate q, and of how bases divide among templates given the depths of their sides."""
    edits = assoc.groupBy("rep_id", "matching").agg(F.sum(c("d") * F.ln(F.lit(q)) + (c("bases") - c("d")) * F.ln(F.lit(1 - q))).alias("e"))
    share = assoc.groupBy("rep_id", "matching", "l", "r").agg(F.sum("bases").alias("bases"))
    x = share.join(depth.select(c("id").alias("l"), c("depth").alias("dl")), "l").join(depth.select(c("id").alias("r"), c("depth").alias("dr")), "r")
    w = Window.partitionBy("rep_id", "matching")
    x = x.withColumn("p", (c("dl") + c("dr")) / F.sum(c("dl") + c("dr")).over(w))
    a = x.groupBy("rep_id", "matching").agg(F.sum(c("bases") * F.ln("p")).alias("a"))
    return edits.join(a, ["rep_id", "matching"]).select("rep_id", "matching", (c("e") + c("a")).alias("score"))


def decide_matching(scores: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(rep_id, matching) whose score is best, where the second best is worse by a ratio of more than accept."""
    w = Window.partitionBy("rep_id").orderBy(c("score").desc(), "matching")
    rows = scores.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("n = 1")
    return rows.where(c("next").isNull() | (c("next") / c("score") > accept)).select("rep_id", "matching", "score")


def resolve_by_likelihood(repeats: DataFrame, sides: DataFrame, middles: DataFrame, reads: DataFrame, depth: DataFrame) -> DataFrame:
    """(rep_id, l, r) of the matching that reads and depths make likeliest."""
    pairs = materialised(matchings(repeats))
    assoc = materialised(read_association(templates(pairs, sides, middles), reads))
    return pairs.join(decide_matching(matching_scores(assoc, depth)), ["rep_id", "matching"]).select("rep_id", "l", "r")


def lambdas(assoc: DataFrame) -> DataFrame:
    """Share of bases that each template of a matching has."""
    return mixing_shares(assoc.withColumn("t", F.concat_ws("_", "rep_id", "matching", "l", "r")), "t", "bases")


def binned(temps: DataFrame, width: int = BIN) -> DataFrame:
    """(.., bin, seq): templates in bins."""
    last = F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / width)
    keep = [n for n in temps.columns if n != "seq"]
    return temps.select(*keep, "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin")).select(*keep, "bin", F.substr("seq", (c("bin") * width + 1).cast("int"), F.lit(width)).alias("seq"))


# consensus


def pair_votes(pairs: DataFrame, key: str = "read") -> DataFrame:
    """Votes on a key's sequence (seq) by others (other), from global alignments."""
    rows = pairs.withColumn("a", global_alignment("seq", "other")).select(key, c("a.a").alias("a1"), c("a.b").alias("a2"))
    return votes(rows, key)


def consensus_edits(rows: DataFrame, key: str, delete: float = DELETE, insert: float = INSERT, sub: float = SUBSTITUTE, least: int = LEAST) -> DataFrame:
    """(key, pos, edit, base) of votes that win: a share of all votes at the place above a threshold, and so many at least. edit: del, sub,
    or ins behind pos."""
    at = rows.where("kind <> 'ins'").groupBy(key, "pos").agg(F.sum("n").alias("all"))
    best = rows.where("kind <> 'same'").groupBy(key, "pos", "kind", "offset").agg(F.max(F.struct("n", "base")).alias("b"))
    joined = best.join(at, [key, "pos"])
    share = F.when(c("kind") == "del", delete).when(c("kind") == "ins", insert).otherwise(sub)
    good = joined.where((c("b.n") >= share * c("all")) & (c("b.n") >= least))
    return good.select(key, "pos", c("kind").alias("edit"), "offset", c("b.base").alias("base"))


def _apply(key: str) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = list(pdf["seq"].iloc[0])
        after: dict[int, list[tuple[int, str]]] = {}
        for pos, edit, offset, base in pdf[["pos", "edit", "offset", "base"]].itertuples(index=False, name=None):
            if edit is None or pos != pos:
                continue
            pos = int(pos)
            if edit == "ins":
                after.setdefault(pos, []).append((int(offset), base))
            elif 0 < pos <= len(seq):
                seq[pos - 1] = "" if edit == "del" else base
        out = "".join(b for _, b in sorted(after.get(0, []))) + "".join(x + "".join(b for _, b in sorted(after.get(i + 1, []))) for i, x in enumerate(seq))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "seq": [out]})

    return run


def corrected(seqs: DataFrame, edits: DataFrame, key: str = "read") -> DataFrame:
    """Sequences (key, seq) with their edits."""
    both = seqs.select(key, "seq").join(edits, key, "left")
    return both.groupBy(key).applyInPandas(_apply(key), seqs.select(key, "seq").schema)


def bin_consensus(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Consensus of each bin's segments (keys.., template, seg): votes on the template's piece by the reads' segments."""
    base = segments.withColumn("_k", F.concat_ws("_", *keys))
    v = votes(base.withColumn("a", global_alignment("template", "seg")).select("_k", c("a.a").alias("a1"), c("a.b").alias("a2")), "_k")
    e = consensus_edits(v, "_k", least=2)
    one = base.groupBy("_k", *keys).agg(F.first("template").alias("seq"))
    return corrected(one.withColumnRenamed("_k", "read"), e.withColumnRenamed("_k", "read")).join(one.select(c("_k").alias("read"), *keys), "read").drop("read")


def differing_places(rows: DataFrame, key: str, low: float = 0.15, least: int = 9, apart: int = 0) -> DataFrame:
    """(key, pos, first, second): places where two letters each have a share above low, and so many votes together. apart: places nearer than that to the place before are dropped."""
    letters = rows.where("kind in ('same', 'sub')").groupBy(key, "pos", "base").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key, "pos")
    ranked = letters.withColumn("all", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(c("n").desc(), "base")))
    two = ranked.where("k <= 2").groupBy(key, "pos", "all").agg(F.max(F.when(c("k") == 1, c("base"))).alias("first"), F.max(F.when(c("k") == 2, c("base"))).alias("second"), F.min("n").alias("low"), F.count("*").alias("c"))
    out = two.where((c("c") == 2) & (c("low") >= c("all") * low) & (c("all") >= least)).select(key, "pos", "first", "second")
    if apart:
        prev = F.lag("pos").over(Window.partitionBy(key).orderBy("pos"))
        out = out.withColumn("p", prev).where(c("p").isNull() | (c("pos") - c("p") >= apart)).drop("p")
    return out


def hypothesis(scored: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(key, choice): one or two variants. scored (key, read, variant, ll): a read's ln likelihood under each variant. Two variants explain a read
    by the mean of both and cost the prior; the larger total wins, ties to one variant, then to the smaller name."""
    # a row for each read with all its variants, from which its singles and pairs are told without a join
    rows = scored.groupBy("key", "read").agg(F.collect_list(F.struct(c("variant").alias("v"), c("ll").alias("x"))).alias("a"))
    told = rows.withColumn("b", F.when(c("key").isNotNull() & c("read").isNotNull(), c("a"))).select("key", "b", F.explode("a").alias("a"))
    # each variant alone (o is null), then with those after it
    told = told.select("key", c("a.v").alias("v"), c("a.x").alias("x"), "b")
    later = F.coalesce(F.filter("b", lambda e: c("v") < e["v"]), F.array().cast(told.schema["b"].dataType))
    told = told.select("key", "v", "x", F.explode(F.concat(F.array(F.lit(None).cast(told.schema["b"].dataType.elementType)), later)).alias("o"))
    m = F.greatest("x", "o.x")
    mixed = m + F.ln((F.exp(c("x") - m) + F.exp(c("o.x") - m)) / 2)
    alone = c("o").isNull()
    told = told.select("key", "v", alone.alias("alone"), c("o.v").alias("w"), F.when(alone, c("x")).otherwise(mixed).alias("s"))
    every = told.groupBy("key", "v", "alone", "w").agg((F.sum("s") + F.when(c("alone"), F.ln(F.lit(1 - prior))).otherwise(F.ln(F.lit(prior)))).alias("s"))
    every = every.select("key", F.when(c("alone"), F.array("v")).otherwise(F.array("v", "w")).alias("choice"), "s")
    return every.groupBy("key").agg(F.min(F.struct((-c("s")).alias("m"), F.size("choice").alias("k"), c("choice"))).alias("t")).select("key", "t.choice")


def phase(reads: DataFrame) -> DataFrame:
    """(rep_id, result): 0 if in1 goes with out1, 1 if in1 goes with out2. reads (rep_id, side l, m or r, seq, v1, v2): v1 and v2 are the two variants of the
    stretch that a read covers
    (for m the variants that link left and right alike or crosswise); a read votes by the difference of their likelihoods, and the signs of left, middle and right decide."""
    ll = reads.withColumn("d", read_likelihood("v1", "seq", F.lit(0.05)) - read_likelihood("v2", "seq", F.lit(0.05)))
    side = ll.groupBy("rep_id").agg(*(F.sum(F.when(c("side") == k, c("d")).otherwise(0.0)).alias(k) for k in ("l", "m", "r")))
    sign = lambda k: F.when(c(k) < 0, -1).otherwise(1)
    return side.select("rep_id", F.when(sign("l") * sign("m") * sign("r") > 0, 0).otherwise(1).alias("result"))


def base_graph_paths(pdf: pd.DataFrame, most: int = 30) -> list[str]:
    """All ways through choices of bases at consecutive places (pos, base), fewer than `most`, else none."""
    ways = [""]
    for _, g in sorted(pdf.groupby("pos")):
        ways = [w + b for w in ways for b in sorted(set(g["base"]))]
        if len(ways) >= most:
            return []
    return ways


def variant_paths(choices: DataFrame, key: str, most: int = 30) -> DataFrame:
    """(key, variant) of choices (key, pos, base)."""
    kind = choices.schema[key].dataType.simpleString()
    return choices.groupBy(key).applyInPandas(lambda p: pd.DataFrame([(p[key].iloc[0], v) for v in base_graph_paths(p, most)], columns=[key, "variant"]), f"{key} {kind}, variant string")


def coordinate_map(pairs: DataFrame, key: str, a1: str = "a1", a2: str = "a2") -> DataFrame:
    """(key, pos, other): for each letter of a1 (1-based, gaps left out) the place of the letter of a2 aligned to it, null at a gap. One row of pairs a key."""
    z = F.arrays_zip(F.split(c(a1), "").alias("x"), F.split(c(a2), "").alias("y"))
    each = pairs.select(key, F.posexplode(z).alias("i", "z")).select(key, "i", c("z.x").alias("x"), c("z.y").alias("y"))
    w = Window.partitionBy(key).orderBy("i")
    told = each.withColumn("pos", F.count_if(c("x") != "-").over(w)).withColumn("other", F.when(c("y") != "-", F.count_if(c("y") != "-").over(w)))
    return told.where("x <> '-'").select(key, "pos", "other")


def cleaned(reads: DataFrame, rounds: int = 2) -> DataFrame:
    """reads (rep_id, read, seq) corrected by the votes of all other reads of their repeat, so many rounds; it ends early when a round changes nothing. Edits beside
    a run of equal letters are left out, as reads err there alike."""
    now = materialised(reads.select("rep_id", "read", "seq"))
    for _ in range(rounds):
        named = now.withColumn("k", F.concat_ws("/", c("rep_id").cast("string"), "read"))
        pairs = named.join(named.select("rep_id", c("read").alias("r"), c("seq").alias("other")), "rep_id").where("read <> r").select("k", "seq", "other")
        edits = consensus_edits(pair_votes(pairs, "k"), "k").join(named.select("k", "seq"), "k").where(~beside_run("seq", "pos")).drop("seq")
        fixed = corrected(named.select("k", "seq"), edits, "k").withColumnRenamed("seq", "new")
        out = materialised(named.join(fixed, "k").select("rep_id", "read", c("new").alias("seq"), (c("new") != c("seq")).alias("changed")))
        now = out.drop("changed")
        if not out.where("changed").limit(1).count():
            break
    return now


# tandem repeats


def tandem_cycles(edges: DataFrame, contigs: int) -> DataFrame:
    """(component, pos, id): the cycles of reads (ids from contigs on) that tandem repeats make: of reads that lead to one another a shortest one through
    the smallest of them."""
    return cycles(edges, c("id") >= contigs)


def copies(matched: DataFrame, unit: int, depth: float) -> DataFrame:
    """One row: copies of a repeat unit by the bases of reads that match a template of many units (each read's longest match counts)."""
    best = matched.groupBy("qry").agg(F.max("len1").alias("n"))
    return best.agg((F.sum("n") / (unit * depth)).alias("copies"))


