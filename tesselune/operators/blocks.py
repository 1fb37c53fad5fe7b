"""Blocks: scan orders, cosine transforms, quantisation and costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselune.operators.ranges import banded
from tesselune.operators.transforms import block_samples, coefficients


def natural_order(spark: SparkSession, width: int = 1, height: int = 1) -> DataFrame:
    """(place, index) of the scan of a block of width x height cells of 8 x 8, width a multiple of height: the
    lowest frequencies line by line, then diagonals x + y * width / height, odd ones downward, even ones upward."""
    w, h, scale = width * 8, height * 8, width // height
    cells = spark.range(w * h).select((F.col("id") % w).alias("x"), F.floor(F.col("id") / w).alias("y"), F.col("id").alias("index"))
    low = (F.col("x") < width) & (F.col("y") < height)
    diagonal = F.when(low, -1).otherwise(F.col("x") + F.col("y") * scale)
    way = F.when(low, F.col("index")).when(diagonal % 2 == 1, F.col("y")).otherwise(-F.col("y"))
    return cells.select((F.row_number().over(Window.orderBy(diagonal, way)) - 1).cast("long").alias("place"), "index")


def block_coefficients(samples: DataFrame, n: int = 8) -> DataFrame:
    """(image_id, channel, by, bx, v, u, coef): the transform of each full n x n block."""
    return coefficients(samples, n, n).drop("place")


def inverse_blocks(coefs: DataFrame, n: int = 8) -> DataFrame:
    """(image_id, channel, y, x, v): the samples of blocks, unrounded."""
    return block_samples(coefs, n, n)


#: Value of a quantised one by channel, and what is taken from larger ones, over their size.
BIAS_ONE = (1 - 0.05465007330715401, 1 - 0.07005449891748593, 1 - 0.049935103337343655)
BIAS_NUMERATOR = 0.145


def dequantise(q: Column, channel: Column) -> Column:
    """A coefficient's value: zero stays, ones shrink by channel, others by 0.145 / q."""
    one = F.when(channel == 0, BIAS_ONE[0]).when(channel == 1, BIAS_ONE[1]).otherwise(BIAS_ONE[2])
    return F.when(q == 0, 0.0).when(q == 1, one).when(q == -1, -one).otherwise(q - F.lit(BIAS_NUMERATOR) / q)


def band_weights(spark: SparkSession, bands: list[float], rows: int = 8, columns: int = 8) -> DataFrame:
    """(y, x, weight): bands of distance from the corner, each a factor on the one before, interpolated
    geometrically in between."""
    table = [bands[0]]
    for factor in bands[1:]:
        table.append(table[-1] * factor)
    steps = len(table) - 1
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("y"), (F.col("id") % columns).alias("x"))
    distance = F.hypot(F.col("y") / max(1, rows - 1), F.col("x") / max(1, columns - 1)) / math.sqrt(2)
    pos = F.greatest(F.lit(0.0), F.least(F.lit(float(steps)), distance * steps))
    at = F.least(F.lit(steps - 1), F.floor(pos).cast("int"))
    values = F.array(*map(F.lit, table))
    low, high = F.get(values, at), F.get(values, at + 1)
    return cells.select("y", "x", (low * F.pow(high / low, pos - at)).alias("weight"))


def quantiser_field(pixels: DataFrame, distance: float = 1.0) -> DataFrame:
    """(image_id, by, bx, qf) of each full 8 x 8 block of pixels (image_id, y, x, c0, c1, c2): from the weighted
    variance and mean change of the channels to between 5 and a maximum that falls with the distance."""
    keys = ["image_id", "by", "bx"]
    rows = pixels.withColumns({"by": F.floor(F.col("y") / 8), "bx": F.floor(F.col("x") / 8)}).repartition(*keys)
    right, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    weights = {"c0": 0.35, "c1": 1.0, "c2": 0.15}
    steps = {c: F.coalesce(F.abs(F.lead(c).over(right) - F.col(c)), F.lit(0.0)) + F.coalesce(F.abs(F.lead(c).over(down) - F.col(c)), F.lit(0.0)) for c in weights}
    rows = rows.select(*keys, *weights, *[s.alias(f"{c}_step") for c, s in steps.items()])
    sums = [f(c).alias(f"{c}_{n}") for c in weights for n, f in (("var", F.var_pop),)] + [F.sum(f"{c}_step").alias(f"{c}_step") for c in weights]
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *sums).where("_n = 64")
    variance = sum((F.col(f"{c}_var") * w for c, w in weights.items()), F.lit(0.0))
    change = sum((F.col(f"{c}_step") / 112 * w for c, w in weights.items()), F.lit(0.0))
    activity = F.sqrt(variance / 1.5) + 0.5 * (change / 1.5)
    most = min(48.0, max(6.0, math.floor(24.0 / max(distance, 0.5) + 0.5)))
    qf = F.round(5.0 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), activity / 0.25)) * (most - 5.0))
    return per.select(*keys, F.when(activity <= 1e-7, 5).otherwise(F.least(F.lit(most), F.greatest(F.lit(5.0), qf))).cast("long").alias("qf"))


def transform_cost(coefs: DataFrame, *keys: str) -> DataFrame:
    """(keys, cost) of quantised coefficients q with their place k: 3.5 a nonzero, a quarter of the magnitudes, 1."""
    q = F.when(F.col("k") > 0, F.col("q")).otherwise(0)
    return coefs.groupBy(*keys).agg((3.5 * F.count_if(q != 0) + 0.25 * F.sum(F.abs(q)) + 1).alias("cost"))


def merge_quads(costs: DataFrame, merged: DataFrame) -> DataFrame:
    """One level of a quadtree: for each parent of up to four cells (image_id, by, bx, cost) the cheaper of the
    cells' sum and the parent's own cost; (image_id, by, bx, cost, whole)."""
    parts = costs.groupBy("image_id", F.floor(F.col("by") / 2).alias("by"), F.floor(F.col("bx") / 2).alias("bx")).agg(F.sum("cost").alias("parts"))
    both = parts.join(merged, ["image_id", "by", "bx"])
    return both.select("image_id", "by", "bx", F.least("parts", "cost").alias("cost"), (F.col("cost") < F.col("parts")).alias("whole"))


def predicted_nonzeros(counts: DataFrame) -> DataFrame:
    """Adds predicted to (image_id, channel, y, x, nz): the mean of above and left, rounded up; one of them at an edge; 32 at the origin."""
    keys = ("image_id", "channel")
    line, column = Window.partitionBy(*keys, "_band", "y").orderBy("x"), Window.partitionBy(*keys, "_band", "x").orderBy("y")
    out = banded(counts, keys, above=1).withColumn("_l", F.lag("nz").over(line)).withColumn("_t", F.lag("nz").over(column)).where("_own")
    return out.withColumn("predicted", F.coalesce(F.shiftright(F.col("_l") + F.col("_t") + 1, 1), "_t", "_l", F.lit(32))).drop("_l", "_t", "_band", "_own")


def nonzero_context(predicted: Column, block: Column, clusters: int = 15) -> Column:
    capped = F.least(F.lit(64), F.greatest(F.lit(0), predicted))
    return block + clusters * F.when(capped < 8, capped).otherwise(4 + F.shiftright(capped, 1))
