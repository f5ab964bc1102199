"""Command line: python -m strandloom repair|split|join|fill CONTIGS READS OUT [-op "key=value ..."],
python -m strandloom short CONTIGS READS OUT -contigs SHORT_CONTIGS -reads SHORT_READS to repair two sets of contigs with the other kind of reads each, and
python -m strandloom breaks|joins TRUTH CONTIGS OUT to score contigs against a true genome. Paths are FASTA files or folders that Spark can open."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators.joins import align, with_lengths
from .plans import evaluate
from .plans.repair import fix, fix_with_short
from .plans.runtime import session
from .plans.splitter import fill_gaps, finish, split
from .plans.stages import Stages
from .schemas import RepairOptions, SplitOptions
from .sources import fasta, tables


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    p.add_argument("command", choices=["repair", "split", "join", "fill", "short", "breaks", "joins"])
    p.add_argument("first", help="contigs; for breaks and joins the truth")
    p.add_argument("second", help="reads; for breaks and joins the contigs")
    p.add_argument("out")
    p.add_argument("-op", default="", help="options as key=value, separated by blanks")
    p.add_argument("-k", type=int, default=20, help="seed length of the similarity join")
    p.add_argument("-scale", type=float, default=1.0, help="factor of lengths that repeats must have")
    p.add_argument("-resume", help="split: folder that all executors share, where stages are kept and read back from")
    p.add_argument("-contigs", help="short: contigs of short reads")
    p.add_argument("-reads", help="short: short reads")
    p.add_argument("-ends", help="fill: list of contigs without a neighbour before or behind; only these ends are joined")
    a = p.parse_args(args)
    if a.command == "short" and not (a.contigs and a.reads):
        p.error("short needs -contigs and -reads")
    spark = session()
    one, two = (fasta.read(spark, x).select("name", "seq") for x in (a.first, a.second))
    if a.command in ("breaks", "joins"):
        lengths = one.union(two).select("name", F.length("seq").alias("len"))
        if a.command == "breaks":
            evaluate.truth_ranges(with_lengths(align(two, one, a.k), lengths)).write.mode("overwrite").parquet(a.out)
        else:
            evaluate.true_successors(with_lengths(align(one, two, a.k), lengths)).write.mode("overwrite").parquet(a.out)
        return
    if a.command == "repair":
        out = fix(one, two, RepairOptions.parse(a.op), a.scale, a.k)
    elif a.command == "split":
        out = split(one, two, SplitOptions.parse(a.op), a.k, Stages(spark, a.resume) if a.resume else None)
    elif a.command == "fill":
        out = fill_gaps(one, two, tables.read_open_ends(spark, a.ends) if a.ends else None, a.k)
    elif a.command == "short":
        contigs, reads = (fasta.read(spark, x).select("name", "seq") for x in (a.contigs, a.reads))
        out = fix_with_short(one, contigs, reads, two, RepairOptions.parse(a.op), k=a.k)
    else:
        out = finish(one, two, a.k)
    numbered = out.withColumn("seq_idx", F.pmod(F.xxhash64("name"), F.lit(1 << 40)))
    fasta.write(numbered, a.out)


if __name__ == "__main__":
    main()
