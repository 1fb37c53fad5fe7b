"""An extension: frame timelines kept up to date as frames arrive. Batch queries of the same name are in plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    """Frames (sequence_id, i, ts, duration) from the event files that appear in a folder."""
    events = spark.readStream.schema(schema).parquet(folder)
    return events.select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("i"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7 + 1).alias("duration"))


def ticks_by_window(frames: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, frames, ticks) of each window of time; a window is final once the watermark has passed it."""
    per = frames.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("frames"), F.sum("duration").alias("ticks"))
    return per.select(F.col("window.start").alias("start"), "frames", "ticks")


def totals(frames: DataFrame) -> DataFrame:
    """(sequence_id, frames, ticks) so far."""
    return frames.groupBy("sequence_id").agg(F.count("*").alias("frames"), F.sum("duration").alias("ticks"))
