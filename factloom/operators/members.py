"""Members of types: what a type inherits, where a call can go, and which overload it means.

Defined cases: null keys match nothing; ties stay; repeated rows count once; a call without a candidate has no row in
``overloads`` and ``unresolved`` as its tier in ``dispatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(ancestors: DataFrame, declared: DataFrame) -> DataFrame:
    """``(type, member, owner, depth)``: for each type and member the nearest declaring ancestor, itself at depth 0.

    ``ancestors (type, owner, depth)`` holds each type itself; ``declared (owner, member)``. What is nearer shadows what
    is further; ties of several bases stay.
    """
    hit = ancestors.join(declared.select("owner", "member").where("owner IS NOT NULL AND member IS NOT NULL").distinct(), "owner")
    nearest = hit.groupBy("type", "member").agg(F.min("depth").alias("depth"))
    return hit.join(nearest, ["type", "member", "depth"]).select("type", "member", "owner", "depth").distinct()


def dispatch(sites: DataFrame, ancestors: DataFrame, declared: DataFrame, instantiated: DataFrame, cap: int) -> DataFrame:
    """``(site, targets, tier)``: where calls ``sites (site, type, member)`` can go.

    Targets are the declarations that the instantiated descendants of the receiver's type, ``instantiated (type)``, look
    up. One is a ``known_edge``, up to ``cap`` a ``dispatch``, more are ``fan_capped``, none is ``unresolved``. Calls of
    equal type and member are resolved once.
    """
    asked = sites.select("type", "member").distinct()
    found = lookup(ancestors, declared)
    below = ancestors.select(F.col("owner").alias("type"), F.col("type").alias("sub")).join(instantiated.select(F.col("type").alias("sub")).distinct(), "sub", "left_semi")
    hit = asked.join(below, "type").join(found.select(F.col("type").alias("sub"), "member", "owner"), ["sub", "member"])
    fan = hit.select("type", "member", "owner").distinct().groupBy("type", "member").agg(F.count(F.lit(1)).alias("targets"))
    n = F.coalesce("targets", F.lit(0))
    tier = F.when(n == 0, "unresolved").when(n == 1, "known_edge").when(n <= cap, "dispatch").otherwise("fan_capped")
    return sites.join(fan, ["type", "member"], "left").select("site", n.alias("targets"), tier.alias("tier"))


def overloads(args: DataFrame, params: DataFrame, candidates: DataFrame, strict: DataFrame, loose: DataFrame) -> DataFrame:
    """``(call, candidate, phase)``: the candidates a call means.

    ``args (call, pos, type)``, ``params (candidate, pos, type)``, ``candidates (call, candidate)``, and which argument
    types a parameter accepts, strictly and with conversion: ``strict``, ``loose (arg, param)``; equal types always. A
    candidate is applicable if it has as many parameters as there are arguments and accepts each; strict ones suppress
    loose ones. Of those left, one goes that another of the same call accepts everywhere and is more special somewhere.
    """
    size = lambda df, by: df.groupBy(by).agg(F.count_distinct("pos").alias("n"))
    arity = candidates.distinct().join(size(args, "call"), "call", "left").join(size(params, "candidate").withColumnRenamed("n", "m"), "candidate", "left").where(F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).select("call", "candidate")
    given = args.select("call", "pos", F.col("type").alias("arg"))
    wanted = params.select("candidate", "pos", F.col("type").alias("param"))
    facing = arity.join(given, "call").join(wanted, ["candidate", "pos"])
    ways = strict.select("arg", "param", F.lit(1).alias("way")).unionByName(loose.select("arg", "param", F.lit(2).alias("way"))).groupBy("arg", "param").agg(F.min("way").alias("way"))
    told = facing.join(ways, ["arg", "param"], "left").withColumn("way", F.when(F.col("arg") == F.col("param"), 1).otherwise(F.coalesce("way", F.lit(3))))
    worst = told.groupBy("call", "candidate").agg(F.max("way").alias("way"))
    fits = arity.join(worst, ["call", "candidate"], "left").select("call", "candidate", F.coalesce("way", F.lit(1)).alias("way")).where("way < 3")
    best = fits.groupBy("call").agg(F.min("way").alias("way"))
    left = fits.join(best, ["call", "way"])
    # one candidate is more special than another if each of its parameters is accepted by the other's, and some differ
    own = left.select("call", "candidate").join(wanted, "candidate")
    a = own.select("call", "pos", F.col("candidate").alias("x"), F.col("param").alias("p"))
    b = own.select("call", "pos", F.col("candidate").alias("y"), F.col("param").alias("q"))
    special = strict.select(F.col("arg").alias("p"), F.col("param").alias("q")).distinct().withColumn("down", F.lit(1))
    pair = a.join(b, ["call", "pos"]).where("x != y").join(special, ["p", "q"], "left")
    beaten = pair.groupBy("call", "x", "y").agg(F.bool_and((F.col("p") == F.col("q")) | F.col("down").isNotNull()).alias("fits"), F.bool_or(F.col("p") != F.col("q")).alias("differs")).where("fits AND differs").select("call", F.col("y").alias("candidate")).distinct()
    return left.join(beaten, ["call", "candidate"], "left_anti").select("call", "candidate", F.when(F.col("way") == 1, "strict").otherwise("loose").alias("phase"))
