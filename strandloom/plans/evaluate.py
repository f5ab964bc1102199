"""Accuracy against the truth: hits of breaks in true ranges, joins of contigs by stage, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import full_length
from ..operators.intervals import gaps, minimal_cover, successors
from ..operators.joins import first_stab

c = F.col


def scores(hits, found, truth) -> DataFrame:
    """Columns precision (1 if nothing was found), recall (1 if nothing is true), f1."""
    p = F.when(found > 0, hits / found).otherwise(1.0)
    r = F.when(truth > 0, hits / truth).otherwise(1.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def truth_ranges(aln: DataFrame, tolerance: int = 30) -> DataFrame:
    """(contig, start, end): where the pieces of a contig that align to the true genome meet. aln: contigs as ref."""
    cover = minimal_cover(aln.select(c("ref").alias("contig"), "s1", "e1"), "contig", "s1", "e1", tolerance)
    return gaps(cover, "contig", "s1", "e1").select("contig", (c("from") - tolerance).alias("start"), (c("to") + tolerance).alias("end"))


def break_scores(breaks: DataFrame, truth: DataFrame, width: int = 1000) -> DataFrame:
    """One row: tp, found, true, precision, recall and f1 of breaks (contig, at) in true ranges (contig, start, end), each range and break counted once."""
    hits = first_stab(breaks, truth, "contig", "at", "start", "end", width).agg(F.count("*").alias("tp"))
    both = hits.crossJoin(breaks.agg(F.count("*").alias("found"))).crossJoin(truth.agg(F.count("*").alias("true")))  # one row each
    return both.select("tp", "found", "true", *scores(c("tp"), c("found"), c("true")))


def true_successors(aln: DataFrame) -> DataFrame:
    """(src, dst): contigs next to each other on the truth, with their strand: full-length hits in order of place. aln: contigs as qry."""
    hits = aln.withColumn("dir", full_length()).where("dir <> 'n'")
    name = F.concat("qry", F.lit("_"), F.when(c("dir") == "f", "p").otherwise("d"))
    return successors(hits.select("ref", "s1", name.alias("name")))


def stage_scores(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Per stage: joins made (each counted at its first stage), how many are true, precision, and recall up to that stage."""
    first = edges.groupBy("src", "dst").agg(F.min("stage").alias("stage"))
    marked = first.join(truth.select("src", "dst").distinct().withColumn("ok", F.lit(1)), ["src", "dst"], "left")
    per = marked.groupBy("stage").agg(F.count("*").alias("found"), F.coalesce(F.sum("ok"), F.lit(0)).alias("tp"))
    total = truth.select("src", "dst").distinct().agg(F.count("*").alias("true"))
    upto = F.sum("tp").over(Window.orderBy("stage"))
    return per.crossJoin(total).select("stage", "found", "tp", F.when(c("found") > 0, c("tp") / c("found")).otherwise(1.0).alias("precision"), F.when(c("true") > 0, upto / c("true")).otherwise(1.0).alias("recall"))
