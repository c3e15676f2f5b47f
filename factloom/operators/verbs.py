"""Answers about a graph: a chain between two ends, what depends on a target, and where a task's words lead.

Defined cases: null nodes are left out; a target that cannot be reached has no chain; ties between chains go to the
smaller node; repeated edges count once; no seeds or no terms give no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.names import subtokens
from factloom.operators import closure
from factloom.session import cut, drop, written


def chains(levels: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``(query, target, step, node)``: one shortest chain to each target of ``targets (query, node)``, step 0 a seed.

    ``levels`` is what ``closure.bfs`` gave over the edges. Chains are read back from their ends, all at once, as many
    rounds as the longest is long.
    """
    near = closure.parents(levels, edges).groupBy("query", "node").agg(F.min("parent").alias("parent"))
    near = cut(near, "parents")
    last = levels.join(targets.select("query", "node").distinct(), ["query", "node"], "left_semi")
    at = cut(last.select("query", F.col("node").alias("target"), F.col("hops").alias("step"), "node"), "chain")
    longest = at.agg(F.max("step").alias("n")).collect()[0].n or 0
    parts = [at]
    for step in range(longest, 0, -1):
        now = at.where(F.col("step") == step)
        back = now.join(near, ["query", "node"]).select("query", "target", F.lit(step - 1).alias("step"), F.col("parent").alias("node"))
        back = cut(back, "chain")
        parts.append(back)
        at = at.where(F.col("step") < step).unionByName(back)
    return reduce(DataFrame.unionByName, parts)


def hops_of_chains(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``(query, target, step, src, dst, rank)``: the hops of chains with the surest rank of their edge."""
    a, b = found.alias("a"), found.alias("b")
    pair = (F.col("a.query") == F.col("b.query")) & (F.col("a.target") == F.col("b.target")) & (F.col("b.step") == F.col("a.step") + 1)
    hops = a.join(b, pair).select("a.query", "a.target", F.col("b.step").alias("step"), F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    hops = cut(hops, "hops")  # few, so that Spark sends them to the edges and not the edges to them
    return hops.join(edges.select("src", "dst", "rank"), ["src", "dst"]).groupBy("query", "target", "step", "src", "dst").agg(F.min("rank").alias("rank"))


def walk_back(levels: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``(query, node, hops)``: the fewest hops back from each target of ``targets (query, node)`` that ``levels`` reach,
    here named ``query``, to the starts of its queries.

    A walk that starts at level 0 and skips no level (``closure.leaps`` says whether any can) has come at least as many
    hops as a node's level when it is there. So a node whose level and hops back are together more than the target's
    level lies on no walk as short, and is not followed: otherwise every target would be paired with all that leads to it.
    """
    ends = levels.join(targets.select("query", "node").distinct(), ["query", "node"], "left_semi")
    level = written(ends.select("query", F.col("node").alias("target"), "node", F.col("hops").alias("room"), F.col("hops").alias("left")), "back")
    met, old = [], []
    for depth in count(1):
        met.append(level.frame.where("left = 0").select(F.col("target").alias("query"), "node", F.lit(depth - 1).alias("hops")))
        old.append(level)
        step = level.frame.alias("a").join(edges.alias("e"), F.col("a.node") == F.col("e.dst")).select("a.query", "a.target", F.col("e.src").alias("node"), "a.room").distinct()
        level = written(step.join(levels.select("query", "node", F.col("hops").alias("left")), ["query", "node"]).where(F.col("left") + depth <= F.col("room")).select("query", "target", "node", "room", "left"), "back")
        if not level.rows:
            break
    back = cut(reduce(DataFrame.unionByName, met).groupBy("query", "node").agg(F.min("hops").alias("hops")), "starts")
    drop(*old, level)
    return back


def unverified(hops: DataFrame, levels: DataFrame, back: DataFrame, edges: DataFrame) -> DataFrame:
    """Chains that a second look does not bear out: a hop that is no edge, or a length that the walk backwards from the
    targets, ``back``, does not give to their start. None if all is right."""
    ends = hops.groupBy("query", "target").agg(F.max("step").alias("length"), F.min_by("src", "step").alias("start"))
    met = edges.select("src", "dst").join(hops.select("src", "dst").distinct(), ["src", "dst"], "left_semi").distinct()
    no_edge = hops.join(met, ["src", "dst"], "left_anti").select("query", "target").distinct()
    other = ends.join(back.select(F.col("query").alias("target"), F.col("node").alias("start"), "hops"), ["target", "start"], "left")
    return no_edge.unionByName(other.where("hops IS NULL OR hops != length").select("query", "target")).distinct()


def impact(edges: DataFrame, targets: DataFrame, is_test: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(section, node, hops, worst)``: who depends on ``targets (query, node)``.

    Sections: ``calls`` at one hop, ``reaches`` at more, and ``tests`` for those of ``is_test (node)`` at any. ``worst`` is
    the worst rank on the surest route, whatever its length.
    """
    back = cut(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rank"), "edges-back")
    hops = closure.bfs(back.select("src", "dst").distinct(), targets, max_depth)
    sure = closure.bottleneck(back, targets).select("query", "node", "worst")
    rows = hops.where("hops > 0").join(sure, ["query", "node"])
    section = F.when(F.col("hops") == 1, "calls").otherwise("reaches")
    tests = rows.join(is_test.select("node").distinct(), "node", "left_semi").withColumn("section", F.lit("tests"))
    out = rows.withColumn("section", section).unionByName(tests)
    return out.select("query", "section", "node", "hops", "worst")


# Weights of a term by how it meets a symbol, what a test keeps of its score, and suffixes of words.
EXACT, PREFIX, PATH_TOKEN, PATH, SUBSTRING, STEMMED, TEST = 1000.0, 100.0, 60.0, 0.5, 1.0, 0.8, 0.05
SUFFIXES = "ations ation ators ator ated ates ate ings ing ions ion ers ors ed es er or s e"
# Words of a task that say nothing about its subject.
STOP = frozenset("a an and are as at be been but by can do does for from get gets has have how if in into is it its just like make must no not of on only or our out same should so some such than that the their then there these this those through to too under up use used was we were what when where which while who why will with would you your about after all also any because before bug issue fix error fails problem code call calls caller callee test tests".split())


def stem(word: Column) -> Column:
    """A word without one suffix, of which at least four letters are left."""
    return F.regexp_replace(word, "^(.{4,}?)(?:" + "|".join(SUFFIXES.split()) + ")$", "$1")


def terms_of(task: str) -> list[str]:
    """The words of a task that say what it is about, each once, identifiers also in parts."""
    words = []
    for raw in re.findall(r"[A-Za-z][A-Za-z0-9]*", task):
        words += [raw, *re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", raw)]
    words = list(dict.fromkeys(w.lower() for w in words if len(w) > 2))
    return [w for w in words if w not in STOP] or words


def context(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """``(id, score, matched)``: how well each of ``symbols (id, name, path, is_test)`` answers the terms, 0 left out.

    Each term adds its weight by the best way in which it meets the name's sub-tokens or the path, times its idf among
    all symbols; the sum grows with the share of terms that meet, and a test keeps little of it.
    """
    spark = symbols.sparkSession
    rows = symbols.select("id", F.lower("name").alias("name"), F.lower(F.coalesce("path", F.lit(""))).alias("path"), F.coalesce("is_test", F.lit(False)).alias("is_test"), F.array_distinct(subtokens(F.col("name"))).alias("own"), subtokens(F.coalesce("path", F.lit(""))).alias("dirs")).where("name IS NOT NULL")
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")  # the words of one task
    known = rows.select(F.explode("own").alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    idf = asked.join(known, "term", "left").crossJoin(F.broadcast(total)).select("term", F.log(1 + F.col("n") / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))
    hit = rows.crossJoin(F.broadcast(idf))  # the stated terms of one task, a handful
    t, own, size = F.col("term"), F.col("own"), F.length("term")
    ahead = F.array_max(F.transform(F.filter(F.array_append(own, F.col("name")), lambda x: x.startswith(t)), lambda x: size / F.length(x)))
    longer = F.array_max(F.transform(F.filter(own, lambda x: t.startswith(x) & (F.length(x) >= 4)), lambda x: F.length(x) / size))
    alike = (size >= 5) & F.exists(own, lambda x: (F.length(x) >= 4) & (stem(x) == stem(t)))
    weight = (
        F.when(F.col("name") == t, EXACT)
        .when(ahead.isNotNull(), PREFIX * F.least(ahead, F.lit(1.0)))
        .when(longer.isNotNull(), PREFIX * F.least(longer, F.lit(1.0)))
        .when(alike, PREFIX * STEMMED)
        .when(F.col("name").contains(t), SUBSTRING)
        .when(F.array_contains("dirs", t), PATH_TOKEN)
        .when(F.col("path").contains(t), PATH)
    )
    met = hit.withColumn("w", weight * F.col("idf")).where("w IS NOT NULL")
    out = met.groupBy("id", "is_test").agg(F.sum("w").alias("w"), F.array_sort(F.collect_list("term")).alias("matched"))
    score = F.col("w") * (1 + F.size("matched") / max(1, len(set(terms)))) * F.when(F.col("is_test"), TEST).otherwise(1.0)
    return out.select("id", F.round(score, 4).alias("score"), "matched")


def seeds(scored: DataFrame) -> DataFrame:
    """``(term, id, score)``: the symbol that answers each term best; ties go to more terms, then to the smaller id.

    One row per term comes out of a partial aggregate, so a term that many symbols meet is in no single task.
    """
    best = F.max(F.struct("score", F.size("matched").alias("n"))).alias("best")
    rows = scored.select("id", "score", "matched", F.explode("matched").alias("term"))
    top = rows.groupBy("term").agg(best).select("term", F.col("best.score").alias("score"), F.col("best.n").alias("n"))
    return rows.withColumn("n", F.size("matched")).join(F.broadcast(top), ["term", "score", "n"]).groupBy("term").agg(F.min("id").alias("id"), F.first("score").alias("score"))
