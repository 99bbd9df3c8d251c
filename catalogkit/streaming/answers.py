"""Answer events as a stream: windowed statistics and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.sources import shared
from catalogkit.sources.files import stream_parquet


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; a folder or one file. The time is read as UTC."""
    return stream_parquet(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(events: DataFrame, at: str, by: str, correct: str, latency: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """By window and group: answers, correct ones, total latency; late events up to ``late``."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by)
    return counted.agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"), F.sum(latency).alias("latency")).select(F.col("w.start").alias("window_start"), by, "total", "correct", "latency")


def with_category(events: DataFrame, categories: DataFrame, on: str, category: str, default: str) -> DataFrame:
    """Each event of the stream with the ``category`` of a static table of distinct ``on``."""
    named = categories.select(F.col(on).alias("__on"), F.col(category).alias("__category"))
    return events.join(named, F.col(on) == F.col("__on"), "left").withColumn(category, F.coalesce("__category", F.lit(default))).drop("__on", "__category")


def sessions(events: DataFrame, user: str, at: str, correct: str, gap: str = "30 minutes", late: str = "1 hour", category: str | None = None) -> DataFrame:
    """Sessions of a user, closed by a gap: answers, correct ones and, if asked for, the distinct categories.

    In append mode a session comes once, when the watermark (``late`` behind the newest answer of the batches
    before) has passed its end; an answer whose own gap ended before the watermark is left out."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), user)
    more = [F.array_sort(F.collect_set(category)).alias("categories")] if category else []
    found = grouped.agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("score"), *more)
    return found.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "total", "score", *(["categories"] if category else []))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over all that is there; the result as a Parquet table. A batch writes it anew as
    ``path/v=<batch>``; the one before stays for its readers, older ones are deleted."""
    spark = stream.sparkSession

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in versions(spark, path)[:-2]:
            shared.delete(spark, f"{path}/v={old}")

    stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/v={versions(spark, path)[-1]}")


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removeprefix("v=")) for name in shared.names(spark, path) if name.startswith("v="))
