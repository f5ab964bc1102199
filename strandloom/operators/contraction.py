"""Strongly connected components, cycles, and graphs of reads contracted before they are searched.

What contigs can be reached does not change when reads of one strongly connected component become one node, when an edge that a way of two edges replaces
goes, or when reads in a row do, each the only way out of the one before and the only way into the next. On what is left a search takes few rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialised
from .graph import components, jumped, reach_through_reads, shortest_paths

c = F.col

#: Edges up to which a class of nodes is searched in one task (some 50 MB of it); larger ones are split by rounds of labels.
LOCAL = 200_000
#: Edges into and out of a node up to which ways of two edges over it are looked at.
DEGREE = 100
#: Steps after which a search that isn't at its end gets its reads contracted.
STEPS = 8


def _compressed(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted names of the nodes of edges (src, dst), starts of their lists, and the lists, ascending."""
    src, dst = (batch.column(k).to_numpy() for k in ("src", "dst"))
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    order = np.lexsort((b, a))
    return names, np.searchsorted(a[order], np.arange(len(names) + 1)), b[order]


def _strong(start: list[int], to: list[int]) -> np.ndarray:
    """The least node of each one's strongly connected component: one depth-first search, components leave the stack at their first node."""
    n = len(start) - 1
    low, at, least = [0] * n, list(start[:-1]), np.arange(n)
    order, place, open_, stack, number = [0] * n, [0] * n, [False] * n, [], 0
    for root in range(n):
        if order[root]:
            continue
        way = [root]
        while way:
            x = way[-1]
            if not order[x]:
                number += 1
                order[x] = low[x] = number
                place[x] = len(stack)
                stack.append(x)
                open_[x] = True
            if at[x] < start[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if not order[y]:
                    way.append(y)
                elif open_[y]:
                    low[x] = min(low[x], order[y])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[x])
            if low[x] == order[x]:
                part = stack[place[x] :]
                del stack[place[x] :]
                least[part] = min(part)
                for y in part:
                    open_[y] = False
    return least


def _components(table: pa.Table) -> pa.Table:
    names, start, to = _compressed(table)
    return pa.table({"id": names, "root": names[_strong(start.tolist(), to.tolist())]})


def _dealt(edges: DataFrame, n: int, local: int) -> DataFrame:
    """Edges with the bucket of their class (cls); classes have `local` edges at most, buckets about as many."""
    return edges.withColumn("bucket", F.pmod(F.xxhash64("cls"), F.lit(-(-n // local))))


def _least_ahead(nodes: DataFrame, step: DataFrame) -> DataFrame:
    """(id, m): the node of least rank that each one of nodes (id, rank) leads to, itself included. Each round hears from the next nodes, then from the
    node named so far: what is known of it is known from here as well, so ways are followed in growing leaps."""
    now = materialised(nodes.select("id", F.struct("rank", "id").alias("m"), F.lit(True).alias("moved")))
    while True:
        told = step.join(now.select(c("id").alias("dst"), "m").hint("merge"), "dst").groupBy(c("src").alias("id")).agg(F.min("m").alias("told"))
        once = now.join(told.hint("merge"), "id", "left").select("id", c("m").alias("old"), F.least("m", "told").alias("m"))
        leap = once.select(c("id").alias("via"), c("m").alias("leap"))
        new = once.join(leap.hint("merge"), c("m.id") == c("via")).select("id", F.least("m", "leap").alias("m"), (F.least("m", "leap") < c("old")).alias("moved"))
        now = materialised(new, now)
        if not now.where("moved").limit(1).count():
            return now.select("id", c("m.id").alias("m"))


def strong_components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, component): the smallest node of each one's strongly connected component, for all nodes of edges (src, dst).

    Classes of nodes that hold whole components are searched in one task each once they have `local` edges at most. More edges than that are split by what
    hangs together in either direction, which ends it where the graph is made of many small parts. A class that is still larger is split by labels: each node
    learns the node of least rank (a hash, new in each round) that leads to it and that it leads to. Where both are the same, that node's component is
    found; edges between nodes that differ in one of them lie in no cycle and go. Each round finds a component of every class, however large."""
    nodes = edges.select(F.explode(F.array(c("src").cast("long"), c("dst").cast("long"))).alias("id")).distinct()
    rest = materialised(edges.where("src <> dst").select(c("src").cast("long"), c("dst").cast("long"), F.lit(0).cast("long").alias("cls")).distinct())
    found, turn, joined = [], 0, False
    while True:
        size = materialised(rest.groupBy("cls").agg(F.count("*").alias("n")))
        n, most = size.agg(F.sum(F.when(c("n") <= local, c("n"))), F.max("n")).first()
        if n:
            small = rest if most <= local else rest.join(size.where(c("n") <= local).select("cls"), "cls", "left_semi")
            found.append(materialised(_dealt(small, n, local).groupBy("bucket").applyInArrow(_components, "id long, root long")))
        if most is None or most <= local:
            break
        large = rest.join(size.where(c("n") > local).select("cls"), "cls", "left_semi")
        if not joined:
            joined = True
            rest = materialised(large.drop("cls").join(components(large, merge=True).select(c("id").alias("src"), c("component").alias("cls")).hint("merge"), "src").select("src", "dst", "cls"), rest)
            continue
        ends = materialised(large.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("rank", F.xxhash64("id", F.lit(turn))))
        ahead = _least_ahead(ends, large.select("src", "dst"))
        behind = _least_ahead(ends, large.select(c("dst").alias("src"), c("src").alias("dst")))
        label = materialised(ahead.withColumnRenamed("m", "to").join(behind.withColumnRenamed("m", "by").hint("merge"), "id"))
        found.append(label.where(c("to") == c("by")).select("id", c("to").alias("root")))
        left = label.where(c("to") != c("by"))
        s, d = left.select(c("id").alias("src"), "to", "by"), left.select(c("id").alias("dst"), "to", "by")
        rest = materialised(large.select("src", "dst").join(s.hint("merge"), "src").join(d.hint("merge"), ["dst", "to", "by"]).select("src", "dst", F.xxhash64("to", "by").alias("cls")), rest)
        turn += 1
    if not found:
        return nodes.select("id", c("id").alias("component"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    names = every.groupBy("root").agg(F.min("id").alias("component"))
    return nodes.join(every.join(names.hint("merge"), "root").select("id", "component").hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


# cycles


def _shortest(start: list[int], to: list[int], root: int) -> list[int]:
    """A shortest cycle through root, breadth first in the order of the nodes."""
    parent, front = {root: -1}, [root]
    while front:
        for x in sorted(front):
            if root in to[start[x] : start[x + 1]]:
                way = [x]
                while parent[way[-1]] >= 0:
                    way.append(parent[way[-1]])
                return way[::-1]
        new = []
        for x in sorted(front):
            for y in to[start[x] : start[x + 1]]:
                if y not in parent:
                    parent[y] = x
                    new.append(y)
        front = new
    raise ValueError("not a strongly connected component")


def _cycles(table: pa.Table) -> pa.Table:
    names, start, to = _compressed(table)
    start, to = start.tolist(), to.tolist()
    roots = np.searchsorted(names, np.unique(table.column("cls").to_numpy()))
    ways = [_shortest(start, to, r) for r in roots.tolist()]
    return pa.table({"component": np.repeat(names[roots], [len(w) for w in ways]), "pos": np.array([k for w in ways for k in range(len(w))], np.int32), "id": names[np.array([x for w in ways for x in w], int)]})


def cycles(edges: DataFrame, among: Column | None = None, local: int = LOCAL) -> DataFrame:
    """(component, pos, id): of each strongly connected component that has an edge, a shortest cycle through its smallest node, from that node (pos 0) on.
    Of equally short ones each node has the smallest node before it that is as near. among: only nodes that fulfil it (a condition on id)."""
    step = edges.select(c("src").cast("long"), c("dst").cast("long")).distinct()
    if among is not None:
        keep = step.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where(among)
        step = step.join(keep.select(c("id").alias("src")), "src", "left_semi").join(keep.select(c("id").alias("dst")), "dst", "left_semi")
    step = materialised(step)
    part = materialised(strong_components(step, local))
    inner = step.join(part.select(c("id").alias("src"), c("component").alias("cls")), "src").join(part.select(c("id").alias("dst"), c("component").alias("cls")), ["dst", "cls"])
    inner = materialised(inner.select("cls", "src", "dst"))
    size = materialised(inner.groupBy("cls").agg(F.count("*").alias("n")))
    n, most = size.agg(F.sum(F.when(c("n") <= local, c("n"))), F.max("n")).first()
    schema = "component long, pos int, id long"
    small = inner if most is None or most <= local else inner.join(size.where(c("n") <= local).select("cls"), "cls", "left_semi")
    out = _dealt(small, max(n or 0, 1), local).groupBy("bucket").applyInArrow(_cycles, schema)
    if most is None or most <= local:
        return out
    large = materialised(inner.join(size.where(c("n") > local).select("cls"), "cls", "left_semi"))
    tree = materialised(shortest_paths(large, size.where(c("n") > local).select(c("cls").alias("id"))))
    # the last node before the way comes back, then all nodes before it by leaps of doubled length
    last = large.where("dst = cls").join(tree.select(c("source").alias("cls"), c("id").alias("src"), "dist"), ["cls", "src"]).groupBy("cls").agg(F.min(F.struct("dist", "src")).alias("x"))
    way = materialised(last.select(c("cls").alias("source"), c("x.src").alias("id")))
    up = materialised(tree.where("parent is not null").select("source", "id", "parent"))
    known = 0
    while (k := way.count()) != known:
        known = k
        way = materialised(way.join(up, ["source", "id"]).select("source", c("parent").alias("id")).union(way).distinct())
        up = materialised(up.join(up.select("source", c("id").alias("parent"), c("parent").alias("next")), ["source", "parent"]).select("source", "id", c("next").alias("parent")))
    return out.union(way.join(tree, ["source", "id"]).select(c("source").alias("component"), c("dist").cast("int").alias("pos"), "id"))


# contraction


def _less(links: DataFrame, reads: Callable[[str], Column]) -> DataFrame:
    """links without edges between reads that a way of two edges over a read replaces; nodes of many edges are not looked at, so some may stay. The graph of
    reads has no cycles, so all may go at once."""
    inner = links.where(reads("src") & reads("dst"))
    few = lambda k: inner.groupBy(c(k).alias("via")).agg(F.count("*").alias("n")).where(c("n") <= DEGREE).select("via")
    via = few("src").join(few("dst").hint("merge"), "via")
    two = inner.withColumnRenamed("dst", "via").join(via.hint("merge"), "via").join(inner.withColumnRenamed("src", "via").hint("merge"), "via").select("src", "dst").distinct()
    return links.join(two.hint("merge"), ["src", "dst"], "left_anti")


def contracted(edges: DataFrame, contigs: int | Column, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """(id, at) for all reads (ids from `contigs` on), and edges (src, dst) between contigs and what reads became: ways through reads join the same contigs.
    All reads with one `at` are reached from the same contigs and lead to the same. Tables here grow with the reads, so they are joined by merging: a
    broadcast in every round would send them to the driver."""
    reads = lambda k: c(k) >= (F.lit(contigs) if isinstance(contigs, int) else contigs)
    step = materialised(edges.select(c("src").cast("long"), c("dst").cast("long")).distinct())
    place = step.select(F.explode(F.array("src", "dst")).alias("id")).where(reads("id")).distinct()
    inner = step.where(reads("src") & reads("dst"))
    if not inner.limit(1).count():
        return place.select("id", c("id").alias("at")), step
    part = strong_components(inner, local)
    place = materialised(place.join(part.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("at")))

    def moved(links: DataFrame, to: DataFrame) -> DataFrame:
        """links between the places of their nodes; to (id, at) has those that move."""
        s, d = to.select(c("id").alias("src"), c("at").alias("s")), to.select(c("id").alias("dst"), c("at").alias("d"))
        both = links.join(s.hint("merge"), "src", "left").join(d.hint("merge"), "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"))
        return both.where((c("src") != c("dst")) | ~reads("src")).distinct()

    links = materialised(moved(step, place.where("id <> at")))
    while True:
        links = materialised(_less(links, reads), links)
        one = lambda k, to: links.groupBy(k).agg(F.min(to).alias(to), F.count("*").alias("n")).where("n = 1").select("src", "dst")  # noqa: E731, B023
        row = materialised(one("src", "dst").join(one("dst", "src").hint("merge"), ["src", "dst"]).where(reads("src") & reads("dst")))
        if not row.limit(1).count():
            return place, links
        ends = row.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        start = ends.join(row.select(c("dst").alias("id"), c("src").alias("up")).hint("merge"), "id", "left")
        head = jumped(start).where("id <> head").select("id", c("head").alias("at"))
        place = materialised(place.join(head.select(c("id").alias("at"), c("at").alias("head")).hint("merge"), "at", "left").select("id", F.coalesce("head", "at").alias("at")), place)
        links = materialised(moved(links, head), links)


def reach(edges: DataFrame, contigs: int | Column, steps: int = STEPS) -> DataFrame:
    """Edges src to dst between contigs (below `contigs`) with a direct edge or a way through reads only. Ways of more than so many edges are searched for
    over contracted reads."""
    near = reach_through_reads(edges, contigs, steps)
    return reach_through_reads(contracted(edges, contigs)[1], contigs) if near is None else near
