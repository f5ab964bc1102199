"""Column functions on sequences, node ids and names; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(seq) -> Column:
    """Upper case, letters other than ACGTN dropped."""
    return F.regexp_replace(F.upper(col(seq)), "[^ACGTN]", "")


def reverse_complement(seq) -> Column:
    return F.translate(F.reverse(clean(seq)), "ACGT", "TGCA")


def codes(seq) -> Column:
    """A, C, G, T, N as 1 to 5, others 0."""
    letters = F.split(F.upper(col(seq)), "")
    return F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.position(c, F.lit("ACGTN")))


def letters(code_list) -> Column:
    """Codes as letters, up to the first 0."""
    stop = F.array_position(col(code_list), F.lit(0))
    kept = F.when(stop > 0, F.slice(col(code_list), F.lit(1), (stop - 1).cast("int"))).otherwise(col(code_list))
    return F.array_join(F.transform(kept, lambda c: F.substr(F.lit("ACGTN"), c, F.lit(1))), "")


def letters(x) -> Column:
    """The letters of a string; none of an empty one."""
    return F.when(F.length(col(x)) > 0, F.split(col(x), "")).otherwise(F.array().cast("array<string>"))


def differing(x, y) -> Column:
    """Differing letters of two lists of letters, up to the end of the shorter one."""
    return F.size(F.filter(F.zip_with(col(x), col(y), lambda p, q: p != q), lambda d: d))


def hamming_prefix(a, b) -> Column:
    """Differing letters on the common prefix length."""
    return differing(letters(a), letters(b))


def edit_counts(a, b) -> Column:
    """Insertions, deletions and substitutions of an aligned pair (gap: -)."""
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.when(x == y, "same").when(x == "-", "ins").when(y == "-", "del").otherwise("sub"))
    count = lambda k: F.size(F.filter(pairs, lambda p: p == k)).alias(k)
    return F.struct(count("ins"), count("del"), count("sub"))


def end_pieces(seq, most: int) -> Column:
    """First and last `most` letters joined; a sequence of at most twice that stays whole."""
    s = col(seq)
    return F.when(F.length(s) <= 2 * most, s).otherwise(F.concat(F.substr(s, F.lit(1), F.lit(most)), F.right(s, F.lit(most))))


def node_of(name) -> Column:
    """Contig3_p, Read3_d: 2 * number, one more for d."""
    return F.regexp_extract(col(name), r"([0-9]+)_[pd]$", 1).cast("long") * 2 + F.endswith(col(name), F.lit("_d")).cast("long")


def name_of(node, contigs: int | Column) -> Column:
    """Name of a node: contigs below the given number of contig nodes, then reads."""
    n, limit = col(node), F.lit(contigs) if isinstance(contigs, int) else contigs
    side = F.when(n % 2 == 0, "_p").otherwise("_d")
    return F.when(n < limit, F.concat(F.lit("Contig"), F.floor(n / 2), side)).otherwise(F.concat(F.lit("Read"), F.floor((n - limit) / 2), side))


def twin(node) -> Column:
    """The same sequence's other strand."""
    return col(node).bitwiseXOR(F.lit(1).cast("long"))


def base2(i) -> Column:
    return F.floor(col(i) / 2)


def base1(i) -> Column:
    return F.floor(col(i) / 4)


def padded(i, width: int) -> Column:
    return F.lpad(col(i).cast("string"), width, "0")


def both_strands(df, name="name", seq="seq"):
    """Every sequence twice: name_p, and name_d as reverse complement."""
    pair = F.array(F.struct(F.lit("p").alias("strand"), clean(seq).alias("s")), F.struct(F.lit("d").alias("strand"), reverse_complement(seq).alias("s")))
    out = df.withColumn("_v", F.explode(pair))
    return out.withColumn(name, F.concat(col(name), F.lit("_"), F.col("_v.strand"))).withColumn(seq, F.col("_v.s")).withColumn("strand", F.col("_v.strand")).drop("_v")


def stitched(pieces, overlaps) -> Column:
    """Pieces of a path joined, each after the first without its overlap with the one before (0 keeps it whole)."""
    cut = F.transform(F.arrays_zip(col(pieces).alias("p"), col(overlaps).alias("o")), lambda z, i: F.when(i == 0, z["p"]).otherwise(F.substr(z["p"], z["o"] + 1)))
    return F.array_join(cut, "")


def around_last_difference(a, b, span: int) -> Column:
    """Both of an aligned pair (a, b) cut to the letters up to span before and behind the last place where they differ; without one, to the first span letters."""
    x, y = col(a), col(b)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))
    at = F.coalesce(F.array_max(places) - 1, F.lit(-1))
    start = F.greatest(at - span, F.lit(0))
    size = F.greatest(F.least(at + span + 1, F.length(x)) - start, F.lit(0))
    return F.struct(F.substr(x, start + 1, size).alias("a"), F.substr(y, start + 1, size).alias("b"))


def beside_run(seq, pos, least: int = 5) -> Column:
    """Whether so many equal letters stand directly before or directly behind a place (1-based): what is read there is often a letter too few or too many."""
    s, p = col(seq), col(pos).cast("int")
    equal = lambda x: x.rlike(r"^(.)\1*$")
    before = (p > least) & equal(F.substr(s, F.greatest(p - least, F.lit(1)), F.lit(least)))
    behind = (p + least <= F.length(s)) & equal(F.substr(s, p + 1, F.lit(least)))
    return before | behind


def by_length(seqs, limit: int):
    """Sequences (seq) longer than limit, and the others."""
    long = F.length("seq") > limit
    return seqs.where(long), seqs.where(~F.coalesce(long, F.lit(False)))
