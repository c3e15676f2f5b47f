"""Inverted index and lexical scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.names import tokens


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(token, key)``, each once; null texts have no tokens."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def idf(index: DataFrame, total: DataFrame) -> DataFrame:
    """``(token, docs, idf)`` with ln(1 + N / (1 + docs)); ``total`` is one row with column ``n``."""
    counts = index.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    return counts.crossJoin(F.broadcast(total)).select("token", "docs", F.round(F.log(1 + F.col("n") / (1 + F.col("docs"))), 6).alias("idf"))


# Weight of a term by how it meets a name.
EXACT, PREFIX, PATH_TOKEN, SUBSTRING = 1000.0, 100.0, 60.0, 1.0


def field_score(name: Column, path: Column, term: str) -> Column:
    """How well a name or path answers one term; a prefix counts by the share of the name that it covers."""
    n = F.lower(name)
    low = term.lower()
    share = F.lit(float(len(low))) / F.greatest(F.length(n), F.lit(1))
    in_path = F.array_contains(F.split(F.lower(path), "[^a-z0-9]+"), low)
    return F.when(n == low, EXACT).when(n.startswith(low), F.round(PREFIX * share, 6)).when(F.coalesce(in_path, F.lit(False)), PATH_TOKEN).when(n.contains(low), SUBSTRING).otherwise(0.0)
