"""FASTA as a DataFrame source and sink. Files are split at each '>' that begins a line by the text reader, so large files are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import balanced_parts

c = F.col


def read(spark: SparkSession, path: str, set_id: str = "", full_header: bool = False) -> DataFrame:
    """set_id, seq_idx (in order of files and places), name (first token of the header, or all of it), seq, len. Blank lines are
    skipped, records without a sequence kept with length 0."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", c("_metadata.file_path").alias("_f"), c("_metadata.file_block_start").alias("_s"))
    raw = raw.withColumn("_i", F.monotonically_increasing_id())
    # the first record of a file has its '>' still; what stands before a file's first '>' is no record
    first = (c("_s") == 0) & (c("_i") == F.min("_i").over(Window.partitionBy("_f", "_s")))
    raw = raw.withColumn("_1", first).where(~c("_1") | F.startswith("value", F.lit(">"))).withColumn("value", F.when(c("_1"), F.substr("value", F.lit(2))).otherwise(c("value")))
    raw = raw.where(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    name = F.trim(head) if full_header else F.regexp_extract(F.trim(head), r"^(\S*)", 1)
    seq = F.regexp_replace(F.substr("value", F.length(head) + 2), r"\s", "")
    block = Window.partitionBy("_f", "_s").orderBy("_i")
    rows = raw.select("_f", "_s", "_i", name.alias("name"), seq.alias("seq")).withColumn("_n", F.row_number().over(block) - 1)
    sizes = rows.groupBy("_f", "_s").agg(F.count("*").alias("_k")).withColumn("_b", F.coalesce(F.sum("_k").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(sizes, ["_f", "_s"]).select(F.lit(set_id).alias("set_id"), (c("_b") + c("_n")).cast("long").alias("seq_idx"), "name", "seq", F.length("seq").alias("len"))


def ordinals(seqs: DataFrame) -> DataFrame:
    """(name, idx): names and their place in the file, in either direction."""
    return seqs.select("name", c("seq_idx").alias("idx"))


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select("name", "len")


def selected(seqs: DataFrame, names: DataFrame) -> DataFrame:
    """Records whose name is listed (name), in any order; each once."""
    return seqs.join(names.select("name").distinct(), "name", "left_semi")


def renumbered(seqs: DataFrame, prefix: str = "Segkk", least: int = 0) -> DataFrame:
    """Records of least letters or more, named prefix0, prefix1, ... in order. Counts per range of indices come first, so no window holds all."""
    rows = seqs.where(F.length("seq") >= least).withColumn("_b", F.floor(c("seq_idx") / 4096))
    base = rows.groupBy("_b").agg(F.count("*").alias("_k")).withColumn("_base", F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = c("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("seq_idx", "name")) - 1
    return rows.join(base, "_b").withColumn("seq_idx", number.cast("long")).withColumn("name", F.concat(F.lit(prefix), c("seq_idx"))).drop("_b", "_k", "_base")


def cleaned(seqs: DataFrame) -> DataFrame:
    """Names without the character that separates fields of alignment text."""
    return seqs.withColumn("name", F.regexp_replace("name", r"\|", ""))


def wrapped(width: int, eol: str = "\n"):
    """Column: seq in lines of so many letters (0: one line)."""
    if not width:
        return c("seq")
    last = F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / width)
    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substr(c("seq"), (i * width + 1).cast("int"), F.lit(width))), eol)


def record(width: int = 0, eol: str = "\n"):
    return F.concat(F.lit(">"), "name", F.lit(eol), wrapped(width, eol))


def write(seqs: DataFrame, path: str, least: int = 10, prefix: str | None = "Segkk", width: int = 0, parts: int = 1) -> None:
    """Records in order of seq_idx, over `parts` files, renumbered unless prefix is None."""
    rows = renumbered(seqs, prefix, least) if prefix is not None else seqs.where(F.length("seq") >= least)
    ordered = rows.repartitionByRange(parts, "seq_idx").sortWithinPartitions("seq_idx") if parts > 1 else rows.orderBy("seq_idx").coalesce(1)
    ordered.select(record(width).alias("value")).write.mode("overwrite").text(path)


def split(seqs: DataFrame, path: str, parts: int, measure: str = "bp", width: int = 60) -> None:
    """Parts of about equal size by bases (bp), bytes of text or number of records (count), one folder each."""
    size = {"bp": c("len"), "count": F.lit(1), "bytes": c("len") + F.length("name") + 2}[measure]
    rows = balanced_parts(seqs.withColumn("_size", size), parts, "_size").drop("_size")
    out = rows.repartition(parts, "part").sortWithinPartitions("part", "seq_idx")
    out.select("part", record(width).alias("value")).write.mode("overwrite").partitionBy("part").text(path)
