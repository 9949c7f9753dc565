"""Streams of samples: an extension beyond the batch operators.

``events`` are (ts, key columns, value). Late rows beyond the watermark are dropped by Spark;
state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream with an event-time column."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, length: str = "1 hour", step: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count, mean and range of values in tumbling (or sliding) windows of event time."""
    w = F.window("ts", length, step) if step else F.window("ts", length)
    agg = stream.withWatermark("ts", late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("ptp"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "ptp")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Runs of samples without a pause of ``gap``."""
    agg = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the collected table (for tests and small jobs)."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
