"""Recursion over edges: breadth-first levels, closures, what lies between, and routes by their worst edge.

Spark has no recursive DataFrame operator that removes duplicates, so a driver loop joins the frontier with the edges
and takes out what was reached before. Each level is written to the shared folder: that cuts the lineage and survives
lost executors. Edges are written once, partitioned for the joins of all rounds by Spark's own choice.

Defined cases: null ends of edges are left out; loops and cycles end; repeated edges count once; no seeds or no edges
give the seeds alone or nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from factloom.session import Written, cut, drop, written

#: Hops of the reference's path queries, which pass it on; reachability has no bound and ends with the frontier.
MAX_DEPTH = 40


def clean_edges(edges: DataFrame, src: str = "src", dst: str = "dst", *more: str) -> DataFrame:
    """Distinct edges ``(src, dst, ...)`` with both ends, written once."""
    out = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more)
    return cut(out.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "edges")


class _Levels:
    """What was reached so far, in tables of which each holds at least twice as many rows as the next.

    A new level is written together with the smaller tables before it, and those are deleted, so that there are few
    tables however many levels, and a row is written again only as often as the whole doubles.
    """

    def __init__(self, name: str) -> None:
        self.name, self.tables = name, []

    def add(self, level: Written) -> None:
        small: list[Written] = []
        rows = level.rows
        while self.tables and self.tables[-1].rows < 2 * rows:
            small.append(self.tables.pop())
            rows += small[-1].rows
        if small:
            self.tables.append(written(reduce(DataFrame.unionByName, [t.frame for t in [*small, level]]), self.name))
            drop(*small)
        else:
            self.tables.append(level)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.frame for t in self.tables])

    def holds(self, table: Written) -> bool:
        return any(t is table for t in self.tables)


def _seeds(seeds: DataFrame) -> DataFrame:
    return seeds.select("query", "node").where(F.col("node").isNotNull()).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """``(query, node, hops)``: the fewest hops from each query's seeds ``(query, node)`` to each node, all that are
    reached unless ``max_depth`` is given.

    ``hubs (node, hub)`` link all nodes of a hub with each other, at one hop. Each hub is opened once, so its pairs are
    never written out.
    """
    level = written(_seeds(seeds).withColumn("hops", F.lit(0)), "bfs")
    levels, opened = _Levels("bfs"), _Levels("hubs")
    levels.add(level)
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached, now = levels.all().select("query", "node"), level.frame
        step = now.join(edges, now.node == edges.src).select("query", F.col("dst").alias("node"))
        if hubs is not None:
            fresh = now.select("query", "node").join(hubs, "node").select("query", "hub").distinct()
            if opened.tables:
                fresh = fresh.join(opened.all(), ["query", "hub"], "left_anti")
            new = written(fresh, "hubs")
            step = step.unionByName(new.frame.join(hubs, "hub").select("query", "node"))
        old = level
        level = written(step.distinct().join(reached, ["query", "node"], "left_anti").withColumn("hops", F.lit(depth)), "bfs")
        if not levels.holds(old):
            drop(old)
        if hubs is not None:
            opened.add(new)
            if not opened.holds(new):
                drop(new)
        if not level.rows:
            drop(level)
            break
        levels.add(level)
    return levels.all()


def parents(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """``(query, node, parent, hops)``: every predecessor that lies one hop nearer."""
    a, b = levels.alias("a"), levels.alias("b")
    back = a.join(edges.alias("e"), F.col("a.node") == F.col("e.dst"))
    near = (F.col("a.query") == F.col("b.query")) & (F.col("e.src") == F.col("b.node")) & (F.col("b.hops") == F.col("a.hops") - 1)
    return back.join(b, near).select("a.query", "a.node", F.col("b.node").alias("parent"), "a.hops")


def leaps(levels: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(query, node)``: nodes with an edge from a level more than one nearer than theirs, or to which an edge leads though
    they have no level. None if the levels of ``bfs`` are right; edges from ``max_depth`` lead out of what was walked."""
    near = levels if max_depth is None else levels.where(F.col("hops") < max_depth)
    next_to = near.join(edges, near.node == edges.src).groupBy("query", F.col("dst").alias("node")).agg(F.min("hops").alias("near"))
    return next_to.join(levels, ["query", "node"], "left").where("hops IS NULL OR hops > near + 1").select("query", "node")


def reverse(edges: DataFrame) -> DataFrame:
    """Edges turned around."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The edges on any walk from the sources to the targets: reached forwards and backwards."""
    down = bfs(edges, sources, max_depth).select(F.col("node").alias("src")).distinct()
    up = bfs(reverse(edges), targets, max_depth).select(F.col("node").alias("dst")).distinct()
    return edges.join(down, "src", "left_semi").join(up, "dst", "left_semi").select("src", "dst")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs ``(src, dst)`` connected by a walk, by doubling: for hierarchies, whose closure stays small."""
    known = fresh = written(edges.select("src", "dst"), "closure")
    while True:
        a, b = fresh.frame.alias("a"), known.frame.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        last, fresh = fresh, written(longer.distinct().join(known.frame, ["src", "dst"], "left_anti"), "closure")
        if last is not known:
            drop(last)
        if not fresh.rows:
            drop(fresh)
            return known.frame
        last, known = known, written(known.frame.unionByName(fresh.frame), "closure")
        drop(last)


def bottleneck(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(query, node, worst)``: the least possible worst rank of an edge on a walk to each node; seeds have -1.

    ``edges`` carry ``rank``. Each round takes the nodes that became better a step further and keeps, for each node
    reached, the least rank unless one as low is known. Ranks only fall, so cycles end.
    """
    level = written(_seeds(seeds).withColumn("worst", F.lit(-1)), "bottleneck")
    levels = _Levels("bottleneck")
    while level.rows:
        levels.add(level)
        now, known = level.frame, levels.all().select(F.col("query").alias("_q"), F.col("node").alias("_n"), F.col("worst").alias("_w"))
        step = now.join(edges, now.node == edges.src).select("query", F.col("dst").alias("node"), F.greatest("worst", F.col("rank").cast("int")).alias("worst"))
        best = step.groupBy("query", "node").agg(F.min("worst").alias("worst"))
        old, level = level, written(best.join(known, F.expr("query = _q AND node = _n AND _w <= worst"), "left_anti"), "bottleneck")
        if not levels.holds(old):
            drop(old)
    levels.add(level)
    return levels.all().groupBy("query", "node").agg(F.min("worst").alias("worst"))


def fixpoint(start: dict[str, DataFrame], rules: list[tuple[str, str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """Relations that define each other, from their starting rows to the least fixpoint, semi-naively.

    A rule is ``(head, body, derive)``: ``derive(fresh, known)`` gives rows of the head from the rows of the relation
    ``body`` that came in the last round and from all rows of every relation. Rounds end when nothing is new, so rules
    must not make ever new values; rows are sets, nulls equal nulls.
    """
    fresh = {name: written(df.distinct(), name) for name, df in start.items()}
    levels = {name: _Levels(name) for name in start}
    for name, table in fresh.items():
        levels[name].add(table)
    while any(t.rows for t in fresh.values()):
        known = {name: own.all() for name, own in levels.items()}
        found: dict[str, list[DataFrame]] = {name: [] for name in start}
        for head, body, derive in rules:
            if fresh[body].rows:
                found[head].append(derive(fresh[body].frame, known).select(known[head].columns))
        last, fresh = fresh, {}
        for name, parts in found.items():
            rows = reduce(DataFrame.unionByName, parts) if parts else known[name].limit(0)
            fresh[name] = written(rows.distinct().subtract(known[name]), name)
        for name, table in last.items():
            if not levels[name].holds(table):
                drop(table)
        for name, table in fresh.items():
            levels[name].add(table) if table.rows else drop(table)
    return {name: own.all() for name, own in levels.items()}
