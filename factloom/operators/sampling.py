"""Bounded samples that depend on the rows alone, not on how they are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_RANGE = 1 << 30


def smallest_hashes(df: DataFrame, key: str, most: int, rows: int | None = None) -> DataFrame:
    """The ``most`` rows whose ``key`` has the smallest hash; all rows where there are no more.

    A threshold on the hash, from the number of rows, first leaves about twice as many, so that what tasks pass on to
    the final sort is bounded however many tasks there are. ``rows`` is the number of rows if known; a larger number
    than the true one only makes the sample smaller. Null keys hash alike and take part.
    """
    rows = df.count() if rows is None else rows
    place = F.pmod(F.xxhash64(key), F.lit(_RANGE))
    if rows > 2 * most:
        df = df.where(place < int(2 * most / rows * _RANGE))
    return df.orderBy(place, key).limit(most)
