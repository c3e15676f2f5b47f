"""What resolving names needs: scopes, sources by priority, inheritance order, listeners, sole candidates, versions.

Candidates are aggregated to one row per key before they are joined, so a name that many declare costs its owners no
more than one that few do. Defined cases: null keys match nothing, and the row stays unresolved; ties between candidates
leave the target null and are told by their number; repeated rows count once; empty tables give unresolved rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.operators import closure
from factloom.session import cut


def by_scope(items: DataFrame, candidates: DataFrame, target: str, scopes: Sequence[Sequence[str]]) -> DataFrame:
    """Items with ``depth``, ``candidates`` and ``target`` of the innermost scope that declares them.

    ``scopes`` lists the columns that agree in each scope, innermost first. Items without any have a null depth.
    """
    out, found = items, []
    for depth, keys in enumerate(scopes):
        n, one = f"_n{depth}", f"_t{depth}"
        own = candidates.select(*keys, target).where(" AND ".join(f"{k} IS NOT NULL" for k in (*keys, target))).distinct()
        out = out.join(own.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min(target).alias(one)), list(keys), "left")
        found.append((F.lit(depth), F.col(n), F.when(F.col(n) == 1, F.col(one))))
    pick = lambda k: F.coalesce(*[F.when(F.col(f"_n{d}").isNotNull(), F.struct(x[0].alias("depth"), x[1].alias("n"), x[2].alias("t"))) for d, x in enumerate(found)]).getField(k)
    return out.select(*items.columns, pick("depth").alias("depth"), pick("n").alias("candidates"), pick("t").alias(target))


def first_source(items: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Items with ``value`` and ``source`` of the first source ``(key, value)`` that has their key."""
    out = items
    for k, (_, rows) in enumerate(sources):
        own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_v{k}"))
        out = out.join(own, key, "left")
    filled = F.coalesce(*[F.col(f"_v{k}") for k in range(len(sources))])
    source = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(name)) for k, (name, _) in enumerate(sources)])
    return out.select(*items.columns, filled.alias(value), source.alias("source"))


def linear_order(bases: DataFrame) -> DataFrame:
    """``(src, dst, position)``: each ancestor's place in the order in which lookups visit them, 0 the first.

    ``bases (src, dst, place)``: the direct bases of a type in the order in which it names them, ``place`` null where it
    doesn't matter. A type comes before its bases, an earlier base of a type before a later one, and so on through what
    these rules put in between. Types whose ancestors this leaves unordered, or puts in a circle, have no rows.
    """
    own = bases.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "place").distinct()
    up = cut(closure.transitive_closure(own.select("src", "dst").distinct()), "ancestors")
    i, j = own.alias("i"), own.alias("j")
    named = i.join(j, (F.col("i.src") == F.col("j.src")) & (F.col("i.place") < F.col("j.place"))).where("i.dst != j.dst").select(F.col("i.dst").alias("src"), F.col("j.dst").alias("dst"))
    before = up if named.isEmpty() else closure.transitive_closure(own.select("src", "dst").unionByName(named).distinct())
    a, b = up.alias("a"), up.alias("b")
    pairs = a.join(before.alias("p"), F.col("a.dst") == F.col("p.src")).join(b, (F.col("b.src") == F.col("a.src")) & (F.col("b.dst") == F.col("p.dst")))
    behind = pairs.groupBy(F.col("b.src").alias("src"), F.col("b.dst").alias("dst")).agg(F.count_distinct("a.dst").alias("n"), F.bool_or(F.col("a.dst") == F.col("b.dst")).alias("circle"))
    rows = up.join(behind, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("position"), F.coalesce("circle", F.lit(False)).alias("circle"))
    # in a total order the positions are 0, 1, 2, ... without a gap
    total = rows.groupBy("src").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("position").alias("k"), F.max("position").alias("top"), F.bool_or("circle").alias("circle")).where("m = k AND top = m - 1 AND NOT circle").select("src")
    return rows.join(total, "src", "left_semi").select("src", "dst", "position")


def listeners(published: DataFrame, listening: DataFrame, ancestors: DataFrame, catch_all: str) -> DataFrame:
    """``(type, listener)``: who hears a published type: listeners to it, to an ancestor, or to everything.

    ``published(type)``, ``listening(listener, type)``, ``ancestors(src, dst)``.
    """
    own = published.select("type").distinct()
    heard = own.select("type", F.col("type").alias("heard"))
    heard = heard.unionByName(own.join(ancestors, own.type == ancestors.src).select("type", F.col("dst").alias("heard"))).unionByName(own.select("type", F.lit(catch_all).alias("heard")))
    return heard.join(listening.select("listener", F.col("type").alias("heard")), "heard").select("type", "listener").distinct()


def last_before(rows: DataFrame, by: str, order: Sequence[str], value: str, where: Column, name: str) -> DataFrame:
    """Rows with the ``value`` of the last earlier row of their group that meets ``where``, as ``name``."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(where, F.col(value)), ignorenulls=True).over(w))


def sole_candidate(rows: DataFrame, key: str, value: str, preferred: Column) -> DataFrame:
    """``(key, n, chosen)``: the only value of a key, else its only preferred one, else none."""
    own = rows.select(key, value, F.coalesce(preferred, F.lit(False)).alias("_p")).where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.bool_or("_p").alias("_p"))
    told = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("_any"), F.count_if("_p").alias("_np"), F.min(F.when(F.col("_p"), F.col(value))).alias("_own"))
    return told.select(key, "n", F.when(F.col("n") == 1, F.col("_any")).when(F.col("_np") == 1, F.col("_own")).alias("chosen"))


def version_changes(versions: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """``(key, at, changed)``: the columns in which a version differs from the one before; nulls equal nulls.

    Versions of equal key and time are ordered by their other columns, so that repeated runs agree.
    """
    rows = versions.select(key, at, *columns).where(F.col(key).isNotNull()).distinct()
    w = W.partitionBy(key).orderBy(F.asc_nulls_first(at), *[F.asc_nulls_first(c) for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)) for c in columns]))
    out = rows.select(key, at, F.row_number().over(w).alias("_k"), F.array_join(names, ",").alias("changed"))
    return out.where("_k > 1 AND changed != ''").drop("_k")
