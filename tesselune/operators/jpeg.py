"""Pixels of JPEG coefficients: transform by block, level shift, nearest upsampling of chroma, colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselune.functions.codes import ycbcr_to_rgb
from tesselune.operators.transforms import block_samples


def component_planes(coefs: DataFrame, quantisers: DataFrame) -> DataFrame:
    """(image_id, channel, y, x, v) of 0 to 255 of quantised coefficients (image_id, channel, by, bx, v, u, q).

    quantisers: (channel, v, u, step), 64 rows a channel. Blocks that lack a coefficient are left out.
    """
    rows = coefs.join(F.broadcast(quantisers), ["channel", "v", "u"])  # 64 rows a channel
    samples = block_samples(rows.select("image_id", "channel", "by", "bx", "v", "u", (F.col("q") * F.col("step") / 8.0).alias("coef")), 8, 8)
    level = F.round(F.round("v", 6)) + 128
    return samples.withColumn("v", F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("long"))


def upsampled(planes: DataFrame, factors: DataFrame) -> DataFrame:
    """(image_id, channel, y, x, v) with each sample repeated across and down; factors: (channel, across, down), a row a channel."""
    rows = planes.join(F.broadcast(factors), "channel")
    many = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    rows = rows.withColumn("dy", many("down")).withColumn("dx", many("across"))
    return rows.select("image_id", "channel", (F.col("y") * F.col("down") + F.col("dy")).alias("y"), (F.col("x") * F.col("across") + F.col("dx")).alias("x"), "v")


def pixels(coefs: DataFrame, quantisers: DataFrame, factors: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, y, x, r, g, b) of three components, cut to the image: all planes meet at their pixels in one shuffle."""
    full = upsampled(component_planes(coefs, quantisers), factors).where((F.col("y") < height) & (F.col("x") < width))
    per = full.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("channel") == k, F.col("v"))).alias(f"p{k}") for k in range(3)])
    r, g, b = ycbcr_to_rgb(F.col("p0"), F.col("p1"), F.col("p2"))
    return per.where("p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL").select("image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))
