"""Comparing two snapshots of a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, change, changed)``: ``added``, ``removed`` or ``changed`` with the names of the changed columns.

    Nulls equal nulls. Keys are unique on each side; a repeated key gives a row per pair.
    """
    o, n = old.select(key, *columns).alias("o"), new.select(key, *columns).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").otherwise("changed")
    out = both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), F.array_join(names, ",").alias("changed"))
    return out.where((F.col("change") != "changed") | (F.col("changed") != ""))
