"""Joins that deductive rules use beyond equality: containment, nearest, longest prefix, for-all, caps, routes.

All of them go by an equality first, so that Spark can partition them; none compares every pair of a table. Defined
cases: null keys join nothing; ties are kept unless a function says otherwise; repeated rows are matched each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def contain(outer: DataFrame, inner: DataFrame, key: str, start: str, end: str, at: str, bin_size: int) -> DataFrame:
    """Rows of ``inner`` with the rows of ``outer`` of equal ``key`` whose [start, end] holds ``at``.

    Numbers are put into bins of ``bin_size``: an outer row stands in each bin that it touches, an inner one in its
    own, so a long list under one key is not compared as a whole.
    """
    low, high = F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size)
    o = outer.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(low, high)))
    i = inner.withColumn("_bin", F.floor(F.col(at) / bin_size))
    return i.join(o, [key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bin")


def nearest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows of the best rank within each group; ties stay."""
    return rows.withColumn("_rank", F.rank().over(W.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def longest_prefix(items: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each item with the longest prefix that it starts with.

    An item joins by those of its own prefixes whose length some prefix has, so this is an equality join and not a
    comparison of all pairs, and no prefix is too long for it.
    """
    known = prefixes.select(prefix).where(F.col(prefix).isNotNull()).distinct()
    lengths = known.agg(F.sort_array(F.collect_set(F.length(prefix))).alias("_lengths"))  # one row
    own = F.filter("_lengths", lambda n: n <= F.length(text))
    cut = items.crossJoin(F.broadcast(lengths)).withColumn(prefix, F.explode(F.transform(own, lambda n: F.substring(F.col(text), F.lit(1), n)))).drop("_lengths")
    return cut.join(known, prefix).groupBy(*items.columns).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def containing(items: DataFrame, text: str, needles: DataFrame, needle: str, size: int = 3) -> DataFrame:
    """Distinct pairs of a text and a needle of at least ``size`` characters that it contains.

    Each needle is looked for by the rarest of its n-grams among the texts, an equality join; what meets is then compared.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda k: F.substr(c, k, F.lit(size))))
    own = items.select(text).where(F.length(text) >= size).distinct().withColumn("_gram", F.explode(grams(F.col(text))))
    counts = own.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    wanted = needles.select(needle).where(F.length(needle) >= size).distinct().withColumn("_gram", F.explode(grams(F.col(needle))))
    rarest = wanted.join(counts, "_gram", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram"))).alias("_r")).select(needle, F.col("_r._gram").alias("_gram"))
    return own.join(rarest, "_gram").where(F.col(text).contains(F.col(needle))).select(text, needle)


def divide(rows: DataFrame, group: str, value: str, required: DataFrame) -> DataFrame:
    """The groups that have every value of ``required``."""
    need = required.select(value).distinct()
    have = rows.select(group, value).distinct().join(need, value)
    total = need.agg(F.count(F.lit(1)).alias("_need"))
    return have.groupBy(group).agg(F.count(F.lit(1)).alias("_have")).join(total, F.col("_have") == F.col("_need")).select(group)


def fan(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, fan)``: the number of distinct values of each key."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("fan"))


def capped(rows: DataFrame, key: str, value: str, cap: int) -> DataFrame:
    """The rows whose key has at most ``cap`` distinct values, and what was left out is told by ``fan``."""
    return rows.join(fan(rows, key, value).where(F.col("fan") <= cap).select(key), key, "left_semi")


def capped_both(writes: DataFrame, registers: DataFrame, key: str, writer: str, declared: str, cap: int, use_cap: int) -> DataFrame:
    """``(writer, declared, key)``: who writes a key with what it registers, for keys that at most ``cap`` declarations
    register and at most ``use_cap`` writers write; others identify nothing. So a key makes at most cap x use_cap rows."""
    few = lambda rows, value, most: capped(rows.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull()), key, value, most).distinct()
    return few(writes, writer, use_cap).join(few(registers, declared, cap), key).where(F.col(writer) != F.col(declared)).select(writer, declared, key)


def segments(path: Column) -> Column:
    """Segments of a path without empty ones; placeholders of any spelling become ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.startswith(":") | s.contains("{") | (s == "*"), "*").otherwise(s))


def match_routes(written: DataFrame, registered: DataFrame) -> DataFrame:
    """``(route, template, same)`` of routes that agree in each segment or meet a placeholder there.

    ``written(route)``, ``registered(template)``. The shape of a route says where it has placeholders; routes and
    templates are few shapes. For each two shapes of equal length both sides get a key, their segments with a
    placeholder wherever either shape has one, and join by it, so only what agrees ever meets. ``same`` is the number
    of equal literals, at least one; the most equal templates of a route are kept.
    """

    def prepare(df: DataFrame, name: str, shape: str) -> DataFrame:
        own = df.select(name, segments(F.col(name)).alias("_s")).where(F.col(name).isNotNull()).distinct()
        return own.withColumn(shape, F.transform("_s", lambda s: s == "*"))

    w, r = prepare(written, "route", "_w"), prepare(registered, "template", "_r")
    a, b = w.select("_w").distinct(), r.select("_r").distinct()
    both = a.join(b, F.size("_w") == F.size("_r")).withColumn("_open", F.zip_with("_w", "_r", lambda x, y: x | y)).where(F.exists("_open", lambda x: ~x))
    key = lambda: F.array_join(F.zip_with("_s", "_open", lambda s, o: F.when(o, "*").otherwise(s)), "/").alias("_key")
    left = w.join(both, "_w").select("route", "_w", "_r", key(), F.aggregate("_open", F.lit(0), lambda n, o: n + F.when(o, 0).otherwise(1)).alias("same"))
    right = r.join(both, "_r").select("template", "_w", "_r", key())
    return nearest(left.join(right, ["_w", "_r", "_key"]), ["route"], [F.desc("same")]).select("route", "template", "same")
