"""Fill-in-the-middle: texts cut at two unit boundaries and reordered, by run-length encoding of character classes.

A text is stored as its maximal runs of one character class, each with the number of units that end up to its last character. Which characters end a unit is
a property of the class (UNITS): each of its characters, the run's last one, or the run's last one if the text ends there. The cut behind u units is in the first
run whose cumulative count reaches u, found by binary search; its offset in the run is arithmetic: characters of such a class all have the same width in bytes, as
width is part of the class. No position of a unit is ever stored. All texts of a slice share one array of runs with running counts, so the cuts of a slice are one search.

Where the cuts fall, whether a text is reordered and in which form come from the first four 32-bit numbers of the SHA-256 of "seed:id", so they depend
on neither order nor partitions. A null id counts as an empty one, a null text as an empty text. Empty texts, texts that contain a sentinel, and those that rate leaves out are plain. Rows that share an id and a text give equal
rows; other columns come through, but for those that have the name of an output (n, form, prefix_chars, middle_chars, output), which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SEPARATOR, map_batches, small_batches, text_slices

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: When characters end a unit: EACH does, the LAST of a run, or the last of a run that ENDS the text.
EACH, LAST, ENDS = 0, 1, 2
#: For each kind of unit: whether a byte is in the second of its two classes, and how characters of the first and of the second end units.
#: Lines keep their line end; words keep what separates them from the word before, and blanks at the end are a unit.
UNITS = {
    "chars": (np.zeros(256, bool), EACH, EACH),
    "lines": (np.arange(256) == 10, ENDS, EACH),
    "words": (SEPARATOR, LAST, ENDS),
}
#: Width in bytes of the character that a byte begins; 0 for the bytes that go on.
WIDTH = np.select([np.arange(256) < 0x80, np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 0, 2, 3], 4)


class Runs:
    """Runs of the texts of one slice: buf holds them one behind the other, offsets delimit them.

    start (in bytes), chars (characters before the run), width (of a character, where each ends a unit) of runs; units: those that end before each run and up to
    all runs' end; of rows: base, the units before the row, and n, its own."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, units: str):
        second, *ends = UNITS[units]
        width = WIDTH[buf]
        lead = np.flatnonzero(width)
        kind = second[buf[lead]].astype(np.int64)
        of_kind = np.array(ends)[kind]
        label = np.where(of_kind == EACH, 8 * kind + width[lead], 8 * kind)
        row = np.searchsorted(offsets, lead, "right") - 1
        new = np.ones(len(lead), bool)
        new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        self.start, self.chars = np.append(lead[first], len(buf)), np.append(first, len(lead))
        self.width, size = np.append(width[lead[first]], 1), np.diff(self.chars)
        last = np.append(row[first][1:] != row[first][:-1], True)[: len(first)]
        how = of_kind[first]
        self.each = np.append(how == EACH, False)
        self.units = np.concatenate([[0], np.cumsum(np.where(how == EACH, size, np.where(how == LAST, 1, last)))])
        at = np.searchsorted(self.start, offsets)
        self.base, self.n, self.first = self.units[at[:-1]], np.diff(self.units[at]), self.chars[at[:-1]]

    def cut(self, row: np.ndarray, behind: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, characters) from the begin of the rows (at byte begin) to where so many of their units end."""
        wanted = self.base[row] + behind
        run = np.maximum(np.searchsorted(self.units, wanted, "left") - 1, 0)
        inside = np.where(self.each[run], wanted - self.units[run], self.chars[np.minimum(run + 1, len(self.chars) - 1)] - self.chars[run])
        to = np.where(self.each[run], self.start[run] + inside * self.width[run], self.start[np.minimum(run + 1, len(self.start) - 1)])
        return np.where(behind > 0, to - begin, 0), np.where(behind > 0, self.chars[run] + inside - self.first[row], 0)


def _check(sentinels: tuple[str, ...]) -> None:
    """Sentinels may not contain one another nor begin with what another one ends with: else the form could not be taken apart again."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or i != j and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("sentinels overlap")


def _transform(units: str, sentinels: tuple[str, str, str]):
    pre, suf, mid = (s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for a, b, buf, offsets in text_slices(batch.column(names.index("_text"))):
                runs = Runs(buf, offsets, units)
                form = batch.column(names.index("_form")).slice(a, b - a).to_numpy(zero_copy_only=False)
                row = np.arange(b - a)
                ends = [batch.column(names.index(k)).slice(a, b - a).to_numpy() % (runs.n + 1) for k in ("_h1", "_h2")]
                p, pc = runs.cut(row, np.minimum(*ends), offsets[:-1])
                m, mc = runs.cut(row, np.maximum(*ends), offsets[:-1])
                out = []
                for i, text in enumerate(np.split(buf, offsets[1:-1])):
                    t = text.tobytes()
                    prefix, middle, suffix = t[: p[i]], t[p[i] : m[i]], t[m[i] :]
                    out.append(t if form[i] == "plain" else pre + prefix + suf + suffix + mid + middle if form[i] == "psm" else suf + suffix + pre + prefix + mid + middle)
                plain = form == "plain"
                kept = [batch.column(k).slice(a, b - a) for k, name in enumerate(names) if name not in ("_text", "_form", "_h1", "_h2")]
                new = [pa.array(runs.n.astype(np.int64)), pa.array(form, pa.string()), pa.array(pc.astype(np.int64), mask=plain), pa.array((mc - pc).astype(np.int64), mask=plain), pa.array([x.decode() for x in out], pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(x for x in names if x not in ("_text", "_form", "_h1", "_h2")), "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def rearranged(docs: DataFrame, units: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, key: str = "doc_id", column: str = "text", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Columns of docs but for the text, and n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    rate: percent of texts that are reordered; spm: percent of these whose suffix comes first. psm is prefix, suffix, middle behind their sentinels; spm has the suffix
    before the prefix."""
    _check(sentinels)
    if units not in UNITS:
        raise ValueError(f"units: one of {', '.join(UNITS)}")
    small_batches(docs.sparkSession)
    made = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [n for n in docs.columns if n != column and n not in made]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    plain = (text == "") | (h[2] % 100 >= rate)
    for s in sentinels:
        plain = plain | F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(*(F.col(f"`{n}`") for n in kept), text.alias("_text"), form.alias("_form"), h[0].alias("_h1"), h[1].alias("_h2"))
    new = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    return map_batches(rows, _transform(units, sentinels), StructType([*docs.select(*(F.col(f"`{n}`") for n in kept)).schema.fields, *new]))


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of: the pieces between the sentinels (none is in a text that was reordered) in their first order."""
    out, kind = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    pre, suf, mid = (F.lit(s) for s in sentinels)
    between = lambda a, b: F.substring_index(F.substr(out, F.locate(a, out) + len(a)), b, 1)
    middle = F.substr(out, F.instr(out, mid) + F.length(mid))
    psm = F.concat(between(sentinels[0], sentinels[1]), middle, between(sentinels[1], sentinels[2]))
    spm = F.concat(between(sentinels[0], sentinels[2]), middle, between(sentinels[1], sentinels[0]))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)
