"""Rasters, byte streams and timelines over the star-schema tables, and rasters in closed form.

A raster is a table of samples (image_id, channel, y, x, v), dense and without nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_raster(spark: SparkSession, sf_dir: str, levels: float = 127.5) -> DataFrame:
    """Rows of the embeddings as lines of an image, elements scaled from [-1, 1]."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return rows.select(
        F.lit("embeddings").alias("image_id"),
        F.lit(0).alias("channel"),
        F.col("vec_id").alias("y"),
        F.col("i").cast("long").alias("x"),
        F.floor((F.col("e").cast("double") + 1.0) * levels).cast("long").alias("v"),
    )


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) of 0 to 255: three elements of an embedding after another are one pixel of its line."""
    level = lambda k: F.floor((F.get("embedding", k).cast("double") + 1.0) * 127.5).cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("x"))
    return rows.select(F.lit("embeddings").alias("image_id"), F.col("vec_id").alias("y"), F.col("x").cast("long").alias("x"), *[level(3 * F.col("x") + c).alias("rgb"[c]) for c in range(3)])


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pixels (a, b, c) of quantity, discount and tax in per cent, with their number n."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("long").alias("a"),
        F.round(F.col("l_discount") * 100).cast("long").alias("b"),
        F.round(F.col("l_tax") * 100).cast("long").alias("c"),
    )
    return rows.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def closed_form(spark: SparkSession, width: int, height: int, v: Column, image_id: str = "closed", channel: int = 0) -> DataFrame:
    """A raster of v, an expression of the columns x and y."""
    cells = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    return cells.select(F.lit(image_id).alias("image_id"), F.lit(channel).alias("channel"), "y", "x", v.cast("long").alias("v"))


def grey12(spark: SparkSession, width: int, height: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return closed_form(spark, width, height, (x * 13 + y * 29 + x.bitwiseXOR(y).bitwiseAND(63)).bitwiseAND(4095), "grey12")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of frames for each user: (sequence_id, i, duration)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence_id"), F.col("event_id").alias("i"), (F.col("event_id") % 7 + 1).alias("duration"))

