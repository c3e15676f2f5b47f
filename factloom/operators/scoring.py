"""Agreement of predicted with true labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def contingency(labels: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts, precision, recall and F1 of two boolean columns; null counts as false, shares of nothing are null."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    one = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    out = labels.agg(one(p & a).alias("tp"), one(p & ~a).alias("fp"), one(~p & a).alias("fn"), one(~p & ~a).alias("tn"))
    share = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), y.cast("double")), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": share("tp", tp + fp), "recall": share("tp", tp + fn), "f1": F.round(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), 6)})
