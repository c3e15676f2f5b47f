"""References to records that do not exist at the time of the reference.

A blocked Bloom filter of all parent keys is built by Spark as a table of blocks, each of four 64-bit words, and
broadcast: its size is fixed by ``MAX_BLOCKS``, not by the data. A reference whose bits are missing is an orphan for
certain and needs no join. The others, with a filter that has grown too full for its keys all of them, are verified
by an exact join with one summary row per parent key; only keys with several closed life spans need a second join
with the spans themselves, cut by month so that no key is joined as a whole.

Defined cases: ids are compared without surrounding white space and letter case; null, '' and '-' are no references;
a reference without a time is an orphan only if its target never exists; a version without a start is live from the
beginning, one without an end for ever, one that ends no later than it starts never; repeated rows count once;
without parents every reference is an orphan, without references the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blocks of the filter at most (256 bits each, about 40 bytes as a row): a bound of some 40 MB on what is broadcast.
MAX_BLOCKS = 1 << 19
#: Bits to a key aimed at below that bound; about one key in a hundred then passes wrongly.
BITS_PER_KEY = 12
#: White space that may surround an id.
BLANKS = " \t\r\n\f\v     　"
_BEGINNING = "0001-01-01"


def clean_id(c: Column) -> Column:
    """An id in the form in which ids are compared; null where there is no id."""
    bare = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(~bare.isin("", "-"), bare)


def references(df: DataFrame, table: str, column: str, key: Column, at: str, target: Column) -> DataFrame:
    """``(ref_table, ref_column, ref_key, target, key, at)`` of one referring column, without the non-references."""
    return df.select(F.lit(table).alias("ref_table"), F.lit(column).alias("ref_column"), key.cast("string").alias("ref_key"), target.alias("target"), clean_id(F.col(column)).alias("key"), F.col(at).alias("at")).where(F.col("key").isNotNull() & F.col("target").isNotNull())


def versions(df: DataFrame, target: str, key: str = "id", start: str = "loaded_at", end: str = "deleted_at") -> DataFrame:
    """``(target, key, start, end)`` of a table of versions, without spans in which nothing lives."""
    out = df.select(F.lit(target).alias("target"), clean_id(F.col(key)).alias("key"), F.coalesce(F.col(start), F.lit(_BEGINNING).cast("timestamp")).alias("start"), F.col(end).alias("end"))
    return out.where(F.col("key").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))


def filter_blocks(keys: int) -> int:
    """Blocks of the filter for so many keys: a power of two within the bound."""
    blocks = 1 << max(0, (max(1, keys) * BITS_PER_KEY // 256).bit_length())
    return min(blocks, MAX_BLOCKS)


def _bits(n: int) -> list[Column]:
    second = F.xxhash64(F.lit(7), "target", "key")
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(second, 6 * k).bitwiseAND(63).cast("int")) for k in range(n)]


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("target", "key"), F.lit(blocks)).alias("block")


def bloom(parents: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows ``(block, w0..w3)``, at most ``blocks`` of them; map-side combined."""
    bits = [b.alias(f"b{k}") for k, b in enumerate(_bits(4))]
    return parents.select(_block(blocks), *bits).groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(4)])


def find_orphans(refs: DataFrame, parents: DataFrame, blocks: int | None = None) -> DataFrame:
    """The orphans among ``refs`` (from ``references``) against ``parents`` (from ``versions``).

    Gives the columns of ``refs`` and ``proof``: ``filter`` where the Bloom filter proves it, ``join`` where the
    exact join does.
    """
    blocks = blocks or filter_blocks(parents.count())
    cols = refs.columns
    words = F.broadcast(bloom(parents, blocks))
    held = F.lit(True)
    for k, bit in enumerate(_bits(4)):
        held = held & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    tested = refs.withColumn("block", _block(blocks)).join(words, "block", "left").withColumn("maybe", F.coalesce(held, F.lit(False))).select(*cols, "maybe")
    sure = tested.where(~F.col("maybe")).select(*cols, F.lit("filter").alias("proof"))

    closed = F.col("end").isNotNull()
    summary = parents.groupBy("target", "key").agg(
        F.min(F.when(~closed, F.col("start"))).alias("open_from"),
        F.min(F.when(closed, F.col("start"))).alias("closed_from"),
        F.max(F.when(closed, F.col("start"))).alias("last_from"),
        F.min(F.when(closed, F.col("end"))).alias("first_to"),
        F.max(F.when(closed, F.col("end"))).alias("closed_to"),
    )
    single = (F.col("closed_from") == F.col("last_from")) & (F.col("first_to") == F.col("closed_to"))
    at = F.col("at")
    inside = F.coalesce((at >= F.col("closed_from")) & (at < F.col("closed_to")), F.lit(False))
    verdict = (
        F.when(F.col("known").isNull(), "orphan")
        .when(at.isNull() | F.coalesce(at >= F.col("open_from"), F.lit(False)), "live")
        .when(~inside, "orphan")
        .when(single, "live")
        .otherwise("spans")
    )
    judged = tested.where("maybe").drop("maybe").join(summary.withColumn("known", F.lit(1)), ["target", "key"], "left").withColumn("verdict", verdict)
    judged = judged.select(*cols, "verdict").where(F.col("verdict") != "live")
    plain = judged.where(F.col("verdict") == "orphan").drop("verdict")

    def month(c: str) -> Column:
        """Months counted through; all before 1970 fall into one, as do all after 2100."""
        return F.least(F.greatest(F.year(c) * 12 + F.month(c), F.lit(1970 * 12)), F.lit(2100 * 12))

    spans = parents.where(closed).select("target", "key", "start", "end").distinct()
    spans = spans.withColumn("month", F.explode(F.sequence(month("start"), month("end"))))
    open_refs = judged.where(F.col("verdict") == "spans").drop("verdict").withColumn("month", month("at"))
    r, s = open_refs.alias("r"), spans.alias("s")
    live = [F.col(f"r.{c}") == F.col(f"s.{c}") for c in ("target", "key", "month")] + [F.col("r.at") >= F.col("s.start"), F.col("r.at") < F.col("s.end")]
    gaps = r.join(s, live, "left_anti").select(*cols)
    return sure.unionByName(plain.unionByName(gaps).withColumn("proof", F.lit("join")))


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Distinct references and orphans per table, column and month of the referring row; '' where that has no time."""
    by = ["ref_table", "ref_column", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("month")]
    pair = lambda df: df.select(*by, "ref_key").distinct().groupBy("ref_table", "ref_column", "month").count()
    total, bad = pair(refs).withColumnRenamed("count", "references"), pair(orphans).withColumnRenamed("count", "orphans")
    return total.join(bad, ["ref_table", "ref_column", "month"], "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)).cast("bigint"))
