"""Predicates on alignment rows (1-based, closed coordinates; reversed if s2 > e2) as columns.

Columns s1, e1, len1 are on ref (length lr), s2, e2, len2 on qry (length lq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ATTACH, DOVETAIL, IDENTICAL, LINK_END, LINK_LENGTH, REPEAT_APART, REPEAT_END, REPEAT_MATCH

c = F.col


def normalised(aln: DataFrame) -> DataFrame:
    """s2 <= e2 in all rows; strand keeps what was swapped."""
    return aln.withColumns({"strand": F.when(c("s2") > c("e2"), "d").otherwise("p"), "s2": F.least("s2", "e2"), "e2": F.greatest("s2", "e2")})


def embedded(mode: str = "LR") -> Column:
    """The read lies in the contig as a whole."""
    if mode == "SR":
        return F.abs(c("len2") - c("lq")) < 7
    return (F.least("s2", "e2") < 20) & (F.greatest("s2", "e2") >= c("lq") - 20)


def head_tail(end: int = DOVETAIL) -> Column:
    """Forward dovetail of two different sequences."""
    left = (c("s1") <= end) & (c("e2") >= c("lq") - end)
    right = (c("e1") >= c("lr") - end) & (c("s2") <= end)
    return (c("ref") != c("qry")) & (c("s2") <= c("e2")) & (left | right)


def identical(near: int = IDENTICAL) -> Column:
    """A match of both whole sequences at the same place."""
    return (F.abs(c("s1") - c("s2")) < near) & (F.abs(c("e1") - c("lr")) < near) & (F.abs(c("e2") - c("lq")) < near)


def end_to_end(least: int = LINK_LENGTH, end: int = LINK_END) -> Column:
    """A long forward match between the end of ref and the start of qry, or the other way round."""
    number = lambda n: F.regexp_extract(n, "([0-9]+)", 1)
    ends = ((c("lr") - c("e1") <= end) & (c("s2") <= end)) | ((c("lq") - c("e2") <= end) & (c("s1") <= end))
    return (number("ref") != number("qry")) & (c("s2") < c("e2")) & (F.least("len1", "len2") > least) & ends


def both_at_end(near: int = ATTACH) -> Column:
    at = lambda s, e, n: (F.least(s, e) <= near) | (F.greatest(s, e) >= c(n) - near)
    return at("s1", "e1", "lr") & at("s2", "e2", "lq")


def read_at_contig(side: str, end: int = DOVETAIL, read_too: bool = True) -> Column:
    """ref a contig, qry a read that leaves it at its right (R) or left (L) end; read_too: the read's own end is in the match."""
    if side == "R":
        return (c("e1") >= c("lr") - end) & ((c("s2") <= end) if read_too else F.lit(True))
    return (c("s1") <= end) & ((c("e2") >= c("lq") - end) if read_too else F.lit(True))


def repeat_match(least: int = REPEAT_MATCH, end: int = REPEAT_END, apart: int = REPEAT_APART) -> Column:
    """A long match between contigs that is more than an overlap of ends, or within one contig far enough apart."""
    low2, high2 = F.least("s2", "e2"), F.greatest("s2", "e2")
    at_end = (F.least(c("s1") - 1, c("lr") - c("e1")) <= end) & (F.least(low2 - 1, c("lq") - high2) <= end)
    return (c("len1") > least) & F.when(c("ref") != c("qry"), ~at_end).otherwise(F.abs(c("s1") - low2) > c("len1") + apart)


def accepted(liid: int = 30) -> Column:
    """A local alignment (score, si, ei, sj, ej, with lengths li, lj) that is long, good and leaves no overhang."""
    span = F.greatest(c("ei") - c("si"), c("ej") - c("sj"))
    over = F.least("si", "sj") + F.least(c("li") - c("ei"), c("lj") - c("ej"))
    return (span >= liid) & (c("score") >= span * 0.5) & (over <= liid)


def full_length(near: int = 30) -> Column:
    """Direction of a hit over the whole query: f, r, or n for none."""
    whole = (F.least("s2", "e2") <= near) & (F.greatest("s2", "e2") >= c("lq") - near)
    return F.when(~whole, "n").when(c("s2") <= c("e2"), "f").otherwise("r")


def inside_interval(start, end, low, high, near) -> Column:
    """An interval that starts, ends or lies within another one, give or take near."""
    s, e = c(start), c(end)
    return ((s >= low - near) & (e <= high + near)) | (F.abs(s - low) <= near) | (F.abs(e - high) <= near)
