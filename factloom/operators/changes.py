"""From changed lines to the declarations they touch, and on to the tests that these reach.

Defined cases: lines without a file or number are left out; a line in no declaration belongs to the file; of
declarations that hold a line, the innermost counts, and ties stay; repeated lines count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators import closure, joins

#: Lines to a bin of the containment join.
BIN = 128


def locate(edits: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """``(file, line, part, id)`` of ``edits (file, line)``: what a changed line belongs to.

    ``methods`` and ``types (id, file, start_line, end_line)``. In order: the header or the body of the innermost method
    around it, else the header or the inside of the innermost type, else the file, with a null id.
    """
    rows = edits.select("file", "line").where("file IS NOT NULL AND line IS NOT NULL").distinct()

    def inner(spans: DataFrame, header: str, inside: str, rank: int) -> DataFrame:
        own = spans.select("id", "file", F.col("start_line").alias("_a"), F.col("end_line").alias("_b")).where("id IS NOT NULL AND _a IS NOT NULL AND _b IS NOT NULL").distinct()
        hit = joins.contain(own, rows, "file", "_a", "_b", "line", BIN)
        best = joins.nearest(hit, ["file", "line"], [F.desc("_a"), F.asc("_b")])
        return best.select("file", "line", F.when(F.col("line") == F.col("_a"), header).otherwise(inside).alias("part"), "id", F.lit(rank).alias("_k"))

    hit = inner(methods, "signature", "body", 0).unionByName(inner(types, "type", "inside", 1))
    best = hit.groupBy("file", "line").agg(F.min("_k").alias("_k"))
    found = hit.join(best, ["file", "line", "_k"]).select("file", "line", "part", "id").distinct()
    none = rows.join(best, ["file", "line"], "left_anti").select("file", "line", F.lit("file").alias("part"), F.lit(None).cast(found.schema["id"].dataType).alias("id"))
    return found.unionByName(none)


def affected(changed: DataFrame, edges: DataFrame, is_test: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(test, hops)``: the tests from which a changed declaration of ``changed (node)`` can be reached, and at how many hops.

    ``edges (src, dst)``, ``is_test (node)``. A changed test is affected at 0 hops.
    """
    seeds = changed.select(F.lit("changed").alias("query"), "node")
    back = closure.reverse(closure.clean_edges(edges))
    return closure.bfs(back, seeds, max_depth).join(is_test.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("test"), "hops")
