"""Logical tables as Spark schemas, and options with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

SEQUENCE = "set_id string, seq_idx long, name string, seq string, len int"
ALIGNMENT = "s1 int, e1 int, s2 int, e2 int, len1 int, len2 int, idy double, ref string, qry string"
BREAKPOINT = "key long, rep long, endpt int, cluster long, contig string, loc int"
INTERVAL = "contig string, start int, end int"
COVERAGE = "contig string, start int, end int, depth int"
SEGMENT = "contig string, seg_idx int, total double, len int"
ABUNDANCE = "contig string, depth double"
EDGE = "src long, dst long, wt int, ord long"
NODE = "id long, members array<long>, overlaps array<int>"
REPEAT = "rep_id long, ins array<long>, outs array<long>"
STAGE_EDGE = "stage int, src string, dst string"


class Options:
    """Options of a stage: unknown names are refused; texts True and False become booleans, other texts numbers."""

    @classmethod
    def load(cls, given: dict | None = None):
        known = {f.name for f in fields(cls)}
        if unknown := set(given or ()) - known:
            raise KeyError(f"unknown options: {', '.join(sorted(unknown))}")
        parse = lambda v: v if not isinstance(v, str) else v == "True" if v in ("True", "False") else float(v)
        return replace(cls(), **{k: parse(v) for k, v in (given or {}).items()})

    @classmethod
    def parse(cls, text: str):
        """From `key=value key=value`."""
        return cls.load(dict(x.split("=", 1) for x in text.split()))


# Defaults that define results.
@dataclass(frozen=True)
class RepairOptions(Options):
    """Cutting misassembled contigs."""

    toRunAdaptor: bool = True
    toRunNoEmbedEnd: bool = True
    toRunAggressive: bool = False
    sdMult: float = 5
    tuneParaOnly: bool = False


@dataclass(frozen=True)
class SplitOptions(Options):
    """Joining contigs through repeats."""

    runGraphSurgery: bool = True
    runBResolve: bool = True
    runXResolve: bool = True
    BRThres: float = 2
    AbunLower: float = 0.5
    AbunUpper: float = 1.95
    AbunUpperX: float = 1.75
    edgeThres: float = 1
    kthres: float = 3
    toRunCondenseRemove: bool = True
    toRunTransitive: bool = True
    toRunDoublePtr: bool = True
    thresMiddleContig: float = 30
    lenthresMiddleContig: float = -1
    bestMatchContigOnly: bool = True
    AggB: bool = False
    AggX: bool = False
    BRB: bool = True
    AbunB: bool = True
    BRX: bool = True
    AbunX: bool = True
    EMB: bool = False
    RThres: float = 5

    def __post_init__(self):
        if self.AbunLower > self.AbunUpper:
            raise ValueError("AbunLower must not exceed AbunUpper")


#: Lengths in base pairs.
ADAPTOR = {"end_zone": 5000, "gap": 5000, "match": 5000}
REDUNDANT = 10
REPEAT_MATCH, REPEAT_END, REPEAT_APART = 8000, 2, 1000
AGGRESSIVE_MATCH, AGGRESSIVE_END, AGGRESSIVE_GAP = 10000, 500, 1000
HIDDEN_APART, CLUSTER_APART, MARK = 400, 60, 15
EXACT_CHOICES = 7
ALPHA, COUNT_STOP = 0.05, 1_000_000
SEGMENT_TRIM, SEGMENT_LEAST, SEGMENT_SPAN = 2, 1, 50_000
OVERLAP_CLIP, OVERLAP_END = 50_000, 10
LINK_LENGTH, LINK_END, LINK_RELAXED = 400, 5, 10
GAP_READS = 12_000
DOVETAIL, IDENTICAL, ATTACH = 10, 20, 50
PHASE_CONTIG = 2000
EDGE_PATHS, EDGE_OVERLAP, EDGE_LENGTH = 100, 5000, 5
