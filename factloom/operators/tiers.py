"""Certainty tiers of derived edges: ranks, classification by the number of targets, and that no site is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rank of each tier, the lowest being the surest; tiers not listed rank 10.
RANKS = {
    0: "known_edge written library boundary_lib boundary_generated implicit_constructor known_implicit_ctor known_builtin_operator",
    1: "runtime_observed multi_inferred",
    2: "dispatch",
    3: "callback_registered event_dispatch",
    4: "defines",
    6: "ambient_terminal intrinsic_terminal dynamic_terminal",
    7: "fan_capped",
    8: "ambiguous_anon ambiguous_dynamic ambiguous_unknown",
    9: "by-name stub",
}
UNLISTED = 10


def rank(tier: Column) -> Column:
    """Rank of a tier; null and unlisted ones rank last."""
    out = F.lit(UNLISTED)
    for r, names in RANKS.items():
        out = F.when(tier.isin(*names.split()), r).otherwise(out)
    return out


def classify(sites: DataFrame, targets: DataFrame, site: str, target: str) -> DataFrame:
    """``(site, targets, tier)`` of every site: none ``unresolved``, one ``known_edge``, more ``multi_inferred``."""
    counts = targets.where(F.col(target).isNotNull()).select(site, target).distinct().groupBy(site).agg(F.count(F.lit(1)).alias("targets"))
    out = sites.where(F.col(site).isNotNull()).select(site).distinct().join(counts, site, "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    return out.withColumn("tier", F.when(F.col("targets") == 0, "unresolved").when(F.col("targets") == 1, "known_edge").otherwise("multi_inferred"))


def conserve(sites: DataFrame, resolved: DataFrame, site: str) -> DataFrame:
    """Resolved rows and, with a null target, every site that has none: no site may vanish."""
    rest = sites.select(site).distinct().join(resolved, site, "left_anti")
    return resolved.unionByName(rest, allowMissingColumns=True)
