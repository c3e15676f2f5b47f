"""Windows over a stream of events, and snapshots kept fresh; the same functions serve tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of a table."""
    return spark.readStream.schema(like.schema).parquet(folder)


def tumbling(events: DataFrame, at: str, size: str, by: list[str], late: str | None = None) -> DataFrame:
    """Events and the sum of their values per window; ``late`` sets the watermark of a stream."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.where(F.col(at).isNotNull()).groupBy(F.window(at, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), *by, "events", "value")


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Events per session: runs of a key's events with pauses shorter than ``gap``."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.where(F.col(at).isNotNull()).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("session_start"), *by, "events")


def _pointer(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/CURRENT")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def keep_fresh(stream: DataFrame, source: Callable[[], DataFrame], rebuild: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Rebuild a derived table whenever its source has changed, as the stream of arriving files tells.

    Each version is rebuilt from the whole of ``source()`` and written beside the others; only then the name of the
    current one is replaced, in one step, so readers (``current``) always see a whole version, and the one before stays
    for those still reading it. A version that was written in part is written anew.
    """
    spark = stream.sparkSession

    def swap(batch: DataFrame, number: int) -> None:
        rebuild(source()).write.mode("overwrite").parquet(f"{target}/version={number}")
        path, fs = _pointer(spark, target)
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/NEXT")
        out = fs.create(draft, True)
        out.writeBytes(str(number))
        out.close()
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        overwrite = spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(draft, path, overwrite)
        for old in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(target)):
            name = old.getPath().getName()
            if name.startswith("version=") and int(name.removeprefix("version=")) < number - 1:
                fs.delete(old.getPath(), True)

    return stream.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The last whole version that ``keep_fresh`` wrote; None before the first."""
    path, fs = _pointer(spark, target)
    if not fs.exists(path):
        return None
    return spark.read.parquet(f"{target}/version={spark.read.text(path.toString()).first()[0]}")
