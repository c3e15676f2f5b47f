"""Scans of fact files and the bundle of result tables with its catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def sentinel(c: Column) -> Column:
    """A text value with '' and '-' as null."""
    return F.when(~c.isin("", "-"), c)


def read_facts(spark: SparkSession, paths: list[str], schema: StructType, quoted: bool = False) -> DataFrame:
    """Tab-separated fact files of one relation under an explicit schema; torn rows come with ``_torn`` set.

    No files give an empty relation.
    """
    if not paths:
        return spark.createDataFrame([], schema).withColumn("_torn", F.lit(None).cast("string"))
    full = StructType(list(schema.fields)).add("_torn", "string")
    reader = spark.read.schema(full).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn")
    reader = reader.option("multiLine", True).option("quote", '"').option("escape", '"') if quoted else reader.option("quote", "")
    return reader.csv(paths)


def merge_graphs(graphs: dict[str, DataFrame]) -> DataFrame:
    """Graphs of several languages as one, with the column ``language``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.withColumn("language", F.lit(k)) for k, g in sorted(graphs.items())])


def write_bundle(tables: dict[str, tuple[DataFrame, list[str]]], folder: str) -> None:
    """Tables with their keys as Parquet, one row per key."""
    for name, (df, keys) in tables.items():
        (df.dropDuplicates(keys) if keys else df.distinct()).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_text(df: DataFrame, folder: str) -> None:
    """A table as tab-separated text with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)


def positional(df: DataFrame) -> DataFrame:
    """A table as text columns c0, c1, ..."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)])


def vocabulary(tables: dict[str, DataFrame], authored: DataFrame) -> DataFrame:
    """``(table_name, column_name, value)`` observed in low-cardinality columns but missing from the authored list."""
    seen = [df.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")).where("value IS NOT NULL").distinct() for t, df in sorted(tables.items()) for c in df.columns]
    return reduce(DataFrame.unionByName, seen).join(authored, ["table_name", "column_name", "value"], "left_anti")


def page(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows with the number of their page and the number of rows in all.

    The position comes from a range-partitioned sort: counts per sorted partition give each one its offset, so no
    single task numbers all rows.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    from pyspark.sql import Window as W

    from factloom.session import cut

    ordered = cut(ordered, "pages")
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total"))
    at = F.col("_before") + F.col("_in")
    return ordered.join(F.broadcast(offsets), "_part").withColumn("page", F.floor(at / size).cast("bigint")).drop("_part", "_in", "_before")
