"""Consensus of short segments by partial order alignment.

The segments of a bin are added to one graph of letters, the most frequent first: each is aligned with the graph at least cost, letters that agree share a node, others get one of
their own. A node weighs as many segments as go through it; the consensus is the way from begin to end whose nodes have most weight above half of all,
so what most segments have is in it, insertions as well, whatever the template.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Costs of a letter that agrees, another letter, a node passed over, a letter put in: what is lacking to a score of 1 a letter of the segment, less 1 for each of the last three.
OTHER, PASSED, PUT_IN = 2, 1, 2
#: Cells a node that are searched one by one, before all are computed in rows.
CELLS = 8
FAR = 1 << 40


class Graph:
    """Nodes by age, begin is 0: letter, weight, nodes before (smaller first) and after. `beside`: nodes of other letters at the same place. `least`, `most`: letters from a node to its
    nearest and farthest end, as of `new`, the ways added since. `last`: ends. `total`: segments added."""

    def __init__(self):
        self.letter: list[str] = []
        self.weight: list[int] = []
        self.before: list[list[int]] = []
        self.after: list[list[int]] = []
        self.beside: list[set[int]] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.last: set[int] = set()
        self.total = 0
        self.new: list[list[int]] = []
        self.vain = self.skip = 0
        self.node("")

    def node(self, letter: str) -> int:
        self.letter.append(letter)
        self.weight.append(0)
        self.before.append([])
        self.after.append([])
        self.beside.append(set())
        self.least.append(FAR)
        self.most.append(-1)
        return len(self.letter) - 1

    def order(self) -> list[int]:
        """Nodes in topological order."""
        waits = [len(us) for us in self.before]
        out = [0]
        for u in out:
            for v in self.after[u]:
                waits[v] -= 1
                if not waits[v]:
                    out.append(v)
        return out

    def cells(self, seq: str) -> dict[int, int] | None:
        """Costs by node * (letters + 1) + place, exact on all ways of least cost through the graph: cells are searched by their cost and the least that is still to come (nodes or letters
        that are left over), to the end of the cost at which an end is reached. None if there are more than CELLS a node."""
        self.measure()
        letter, after, least, most, last = self.letter, self.after, self.least, self.most, self.last
        m, width, bound = len(seq), len(seq) + 1, CELLS * len(self.letter)
        cost: dict[int, int] = {}
        todo: dict[int, list[tuple[int, int, int]]] = {}

        def reach(v: int, j: int, g: int) -> None:
            at = v * width + j
            if g < cost.get(at, FAR):
                cost[at] = g
                rest = m - j
                more = least[v] - rest if least[v] > rest else PUT_IN * (rest - most[v]) if rest > most[v] else 0
                todo.setdefault(g + more, []).append((v, j, g))

        def others(v: int, j: int, g: int) -> None:
            x = seq[j] if j < m else ""
            for w in after[v]:
                if x and letter[w] != x:
                    reach(w, j + 1, g + OTHER)
                reach(w, j, g + PASSED)
            if x:
                reach(v, j + 1, g + PUT_IN)

        reach(0, 0, 0)
        now = min(todo)
        while True:
            found, later = False, []
            for v, j, g in todo.get(now, ()):
                if cost[v * width + j] < g:
                    continue
                if len(cost) > bound:
                    return None
                if j < m:
                    x = seq[j]
                    for w in after[v]:
                        if letter[w] == x:
                            reach(w, j + 1, g)
                elif v in last:
                    found = True
                # steps that cost something lead to dearer cells, unless they were expected
                if g < now:
                    others(v, j, g)
                else:
                    later.append((v, j, g))
            if found:
                return cost
            for cell in later:
                others(*cell)
            now += 1

    def rows(self, seq: str) -> list[np.ndarray]:
        """Costs of all places, node by node."""
        step = PUT_IN * np.arange(len(seq) + 1)
        letters = np.frombuffer(seq.encode("utf-32-le"), np.int32)
        out = [step] * len(self.letter)
        for v in self.order()[1:]:
            other = np.where(letters == ord(self.letter[v]), 0, OTHER)
            above = np.min([out[u] for u in self.before[v]], axis=0)
            row = np.concatenate([[above[0] + PASSED], np.minimum(above[:-1] + other, above[1:] + PASSED)])
            out[v] = np.minimum.accumulate(row - step) + step
        return out

    def costs(self, seq: str) -> Callable[[int, int], int]:
        """Cost of a cell by node and place. After a search in vain the next segment is not searched for, after another the next three, and so on."""
        if self.skip:
            self.skip -= 1
        else:
            cells, width = self.cells(seq), len(seq) + 1
            if cells is not None:
                self.vain = 0
                return lambda v, j: cells.get(v * width + j, FAR)
            self.vain += 1
            self.skip = 2**self.vain - 1
        rows = self.rows(seq)
        return lambda v, j: rows[v][j]

    def aligned(self, seq: str) -> list[tuple[int, int]]:
        """(node or 0, place or -1) of the best global alignment of seq with a way through the graph."""
        cost, letter, before = self.costs(seq), self.letter, self.before
        j = len(seq)
        v = min(self.last, key=lambda u: (cost(u, j), u))
        out: list[tuple[int, int]] = []
        while v or j:
            if v:
                here = cost(v, j)
                if j:
                    there = here if seq[j - 1] == letter[v] else here - OTHER
                    for u in before[v]:
                        if cost(u, j - 1) == there:
                            break
                    else:
                        u = -1
                    if u >= 0:
                        out.append((v, j - 1))
                        v, j = u, j - 1
                        continue
                u = next((u for u in before[v] if cost(u, j) + PASSED == here), -1)
                if u >= 0:
                    out.append((v, -1))
                    v = u
                    continue
            out.append((0, j - 1))
            j -= 1
        return out[::-1]

    def add(self, seq: str, times: int) -> None:
        at = 0
        way = [0]
        pairs = self.aligned(seq) if self.last else [(0, j) for j in range(len(seq))]
        for v, j in pairs:
            if j < 0:
                continue
            if not v:
                to = self.node(seq[j])
            elif self.letter[v] == seq[j]:
                to = v
            else:
                to = next((u for u in sorted(self.beside[v]) if self.letter[u] == seq[j]), -1)
                if to < 0:
                    to = self.node(seq[j])
                    ring = self.beside[v] | {v}
                    for u in ring:
                        self.beside[u].add(to)
                    self.beside[to] = set(ring)
            if at not in self.before[to]:
                insort(self.before[to], at)
                self.after[at].append(to)
            self.weight[to] += times
            at = to
            way.append(to)
        self.last.add(at)
        self.total += times
        # two stand for more
        self.new = [*self.new[:1], way]

    def measure(self) -> None:
        """Letters to the nearest and farthest end: along the way that was added, and on from nodes for which they change; of all nodes if several were."""
        least, most, new = self.least, self.most, self.new
        if not new:
            return
        self.new = []
        if len(new) > 1:
            for v in reversed(self.order()):
                ends = [0] if v in self.last else []
                least[v] = min(ends + [least[w] + 1 for w in self.after[v]])
                most[v] = max(ends + [most[w] + 1 for w in self.after[v]])
            return
        way = new[0]
        least[way[-1]], most[way[-1]] = 0, max(most[way[-1]], 0)
        todo = deque(way[::-1])
        waits = set(way)
        while todo:
            v = todo.popleft()
            waits.discard(v)
            near, far = least[v] + 1, most[v] + 1
            for u in self.before[v]:
                if near < least[u] or far > most[u]:
                    least[u], most[u] = min(near, least[u]), max(far, most[u])
                    if u not in waits:
                        waits.add(u)
                        todo.append(u)

    def consensus(self) -> str:
        """The letters of the way of most weight above half, ties to older nodes."""
        score: list[tuple[float, int]] = [(0.0, -1)] * len(self.letter)
        for v in self.order()[1:]:
            best = max(self.before[v], key=lambda u: (score[u][0], -u))
            score[v] = (score[best][0] + self.weight[v] - self.total / 2, best)
        v = max(self.last, key=lambda u: (score[u][0], -u))
        out = []
        while v:
            out.append(self.letter[v])
            v = score[v][1]
        return "".join(out[::-1])


def consensus(segments: list[tuple[str, int]]) -> str:
    """Of segments with how often each occurs, the most frequent first (ties by letters)."""
    graph = Graph()
    for seq, times in sorted(segments, key=lambda s: (-s[1], s[0])):
        graph.add(seq, times)
    return graph.consensus()


def _consensus(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys.., _s, _n, _last) in order of bins, the most frequent first: a row for the last one of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph()
        for batch in batches:
            out = []
            for seq, times, last in zip(*(batch.column(k).to_pylist() for k in ("_s", "_n", "_last")), strict=True):
                graph.add(seq, times)
                if last:
                    out.append(graph.consensus())
                    graph = Graph()
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(batch.column("_last")) for k in keys] + [pa.array(out, pa.string())], [*keys, "seq"])

    return run


def bin_consensus(segments: DataFrame, keys: list[str], seg: str = "seg") -> DataFrame:
    """(keys.., seq): consensus of the segments of each bin. Equal segments are counted before they leave for their bin, and bins are streamed in order, so a task holds one graph and a
    batch. Bins are dealt over as many tasks as shuffle partitions at least, however few bytes they have. A null counts as empty."""
    spark = segments.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = segments.select(*keys, F.coalesce(seg, F.lit("")).alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(c("_n").desc(), "_s")
    rows = counted.repartition(parts, *keys).withColumn("_last", F.lead(F.lit(True)).over(order).isNull())
    fields = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_consensus(keys), f"{fields}, seq string")
