"""Neighbourhoods of samples, predictors over them and decision trees on their properties.

Samples of a raster are dealt out by image, channel and, where tiled, tile, in bands of lines with the two lines
before as a halo; both the line and the column windows ask for no more than that, so one shuffle serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselune.functions.codes import hybrid_uint, zigzag
from tesselune.operators.ranges import banded


def tiled(samples: DataFrame, size: int) -> DataFrame:
    """Adds the tile (gy, gx) of a sample; neighbourhoods with these keys end at the tile's edges."""
    return samples.withColumn("gy", F.floor(F.col("y") / size)).withColumn("gx", F.floor(F.col("x") / size))


def neighbours(samples: DataFrame, keys: tuple[str, ...] = ("image_id", "channel"), edges: bool = False) -> DataFrame:
    """Adds w, n, nw, ne, ww, nn; with ``edges`` also top and left, whether a sample is in the first line or column.

    At edges: w falls back to n, then 0; n to w; nw to w, or n in the first column; ne to n; ww to w; nn to n.
    """
    line, column = Window.partitionBy(*keys, "_band", "y").orderBy("x"), Window.partitionBy(*keys, "_band", "x").orderBy("y")
    out = banded(samples, keys, above=2)
    out = out.withColumn("_n", F.lag("v").over(column)).withColumn("_nn", F.lag("v", 2).over(column))
    out = out.select("*", *[f(c, k).over(line).alias(a) for a, f, c, k in (("_w", F.lag, "v", 1), ("_ww", F.lag, "v", 2), ("_nw", F.lag, "_n", 1), ("_ne", F.lead, "_n", 1), ("_first", F.lag, "x", 1))])
    out = out.where("_own")
    if edges:
        out = out.withColumns({"top": F.col("_n").isNull(), "left": F.col("_first").isNull()})
    out = out.withColumn("w", F.coalesce("_w", "_n", F.lit(0)))
    out = out.withColumn("n", F.coalesce("_n", "w"))
    out = out.withColumn("nw", F.coalesce("_nw", F.when(F.col("_first").isNotNull(), F.col("w")).otherwise(F.col("n"))))
    out = out.withColumns({"ne": F.coalesce("_ne", "n"), "ww": F.coalesce("_ww", "w"), "nn": F.coalesce("_nn", "n")})
    return out.drop("_n", "_nn", "_w", "_ww", "_nw", "_ne", "_first", "_band", "_own")


def gradient(w: Column, n: Column, nw: Column) -> Column:
    """w + n - nw, kept between w and n."""
    return F.greatest(F.least(w, n), F.least(F.greatest(w, n), w + n - nw))


def predictor(kind: int) -> Column:
    """The standard predictors 0 to 13 but 6, which adapts to what is decoded."""
    w, n, nw, ne, ww = (F.col(c) for c in ("w", "n", "nw", "ne", "ww"))
    return {
        0: F.lit(0).cast("long"),
        1: w,
        2: n,
        3: F.shiftright(w + n, 1),
        4: F.when(F.abs(w - nw) < F.abs(n - nw), n).otherwise(w),
        5: gradient(w, n, nw),
        7: ne,
        8: nw,
        9: ww,
        10: F.shiftright(w + nw, 1),
        11: F.shiftright(nw + n, 1),
        12: F.shiftright(n + ne, 1),
        13: F.shiftright(w + n + ne + nw, 2),
    }[kind]


def properties(samples: DataFrame) -> dict[int, Column]:
    """The tree properties 0 to 14 of a sample with its neighbours; tile numbers stand for the group."""
    w, n, nw, ne, ww, nn = (F.col(c) for c in ("w", "n", "nw", "ne", "ww", "nn"))
    group = F.col("gy") * 65536 + F.col("gx") if "gx" in samples.columns else F.lit(0)
    out = [F.col("channel"), group, F.col("y"), F.col("x"), F.abs(n), F.abs(w), n, w, w - n, w + n - nw, w - nw, nw - n, n - ne, n - nn, w - ww]
    return {k: c.cast("long") for k, c in enumerate(out)}


def tree_leaf(tree: tuple, props: dict[int, Column]) -> Column:
    """The leaf that a sample reaches. tree: a leaf's number, or (property, split, left, right), left if above the split."""
    if not isinstance(tree, tuple):
        return F.lit(tree)
    prop, split, left, right = tree
    return F.when(props[prop] > split, tree_leaf(left, props)).otherwise(tree_leaf(right, props))


def residual_tokens(samples: DataFrame, kind: int = 5, split: int = 4, msb: int = 0, lsb: int = 0) -> DataFrame:
    """Adds the residual of a predictor and its token, extra bits and their number."""
    out = neighbours(samples).withColumn("residual", F.col("v") - predictor(kind))
    token, extra, count = hybrid_uint(zigzag(F.col("residual")), split, msb, lsb)
    return out.withColumns({"token": token, "extra": extra, "n_extra": count})


def plane_residuals(samples: DataFrame, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """Residuals of a whole plane: the first sample as it is, the first line by w, the first column by n, else the gradient."""
    out, top, left = neighbours(samples, keys, edges=True), F.col("top"), F.col("left")
    guess = F.when(top & left, 0).when(top, F.col("w")).when(left, F.col("n")).otherwise(gradient(F.col("w"), F.col("n"), F.col("nw")))
    return out.withColumn("residual", F.col("v") - guess).drop("top", "left")


def lossless_jpeg_residuals(samples: DataFrame, kind: int, precision: int = 8) -> DataFrame:
    """Residuals of the lossless JPEG predictors 1 to 7, modulo 65536: the first line predicts left, its first
    sample half the range, the first column above. Samples start at x = y = 0."""
    a, b, c = F.col("w"), F.col("n"), F.col("nw")
    inner = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + F.shiftright(b - c, 1), 6: b + F.shiftright(a - c, 1), 7: F.shiftright(a + b, 1)}[kind]
    guess = F.when((F.col("x") == 0) & (F.col("y") == 0), 1 << (precision - 1)).when(F.col("y") == 0, a).when(F.col("x") == 0, b).otherwise(inner)
    return neighbours(samples).withColumn("residual", F.pmod(F.col("v") - guess, F.lit(65536)))
