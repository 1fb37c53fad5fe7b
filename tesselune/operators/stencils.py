"""Stencil filters over rasters: a weighted sum of the samples around each sample.

Lines are gathered by bands with a halo, so a sample meets its neighbours inside one group of a bounded number of
lines whatever the image's height, in one shuffle; no join of offsets with pixels is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselune.operators.ranges import banded


def mirrored(at: Column, size: Column) -> Column:
    """A coordinate at most ``size`` outside, reflected at the edges: -1 is 0, size is size - 1."""
    return F.when(at < 0, -at - 1).when(at >= size, 2 * size - 1 - at).otherwise(at)


def clamped(at: Column, size: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(at, size - 1))


#: Weights of the 3x3 smoothing beside a centre of 1, for sides and corners.
GABORISH = (0.115169525, 0.061248592)
#: Weights of the 5x5 sharpening beside a centre of 1, at distances (0,1), (1,1), (0,2), (1,2), (2,2).
SHARPEN = {(0, 1): -0.09495815671340026, (1, 1): -0.041031725066768575, (0, 2): 0.013710004822696948, (1, 2): 0.006510206083837737, (2, 2): -0.0014789063378272242}
#: Weights of centre, sides and corners of the DC smoothing.
SMOOTHING = (0.05226273532324128, 0.20345139757231578, 0.0334829185968739)


def gaborish_weights() -> dict[tuple[int, int], float]:
    total = 1 + 4 * sum(GABORISH)
    return {(dy, dx): (1.0, *GABORISH)[abs(dx) + abs(dy)] / total for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def sharpen_weights() -> dict[tuple[int, int], float]:
    w = SHARPEN | {(0, 0): 1.0}
    full = {(dy, dx): w[tuple(sorted((abs(dx), abs(dy))))] for dy in range(-2, 3) for dx in range(-2, 3)}
    total = sum(full.values())
    return {k: v / total for k, v in full.items()}


def stencil(samples: DataFrame, weights: dict[tuple[int, int], float], edge=clamped, out: str = "filtered") -> DataFrame:
    """(image_id, channel, y, x, v, out): the weighted sum around each sample, v outside the image taken by ``edge``.

    Columns of a line are neighbours in an array, lines above and below in a window by bands with a halo.
    """
    keys, far = ("image_id", "channel"), max(abs(dy) for dy, _ in weights)
    banded_rows = banded(samples, keys, above=2 * far, below=2 * far)
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", F.col("v").cast("double").alias("v")))), lambda s: s["v"])
    rows = banded_rows.groupBy(*keys, "_band", "_own", "y").agg(line.alias("line"), F.min("x").alias("x0"))
    down = Window.partitionBy(*keys, "_band").orderBy("y")
    reach = range(-2 * far, 2 * far + 1)
    rows = rows.select("*", *[F.lag("line", -d).over(down).alias(f"l{d + 2 * far}") for d in reach]).where("_own")
    # a line that is missing lies outside the image: so far its edge is known, and further no weight reaches
    up, below = (sum((F.col(f"l{d + 2 * far}").isNotNull().cast("long") for d in reach if d * side > 0), F.lit(0)) for side in (-1, 1))
    picked = {}
    for dy in sorted({dy for dy, _ in weights}):
        at = edge((up + dy).cast("long"), up + 1 + below) - up
        choice = F.lit(None).cast("array<double>")
        for d in reach:
            choice = F.when(at == d, F.col(f"l{d + 2 * far}")).otherwise(choice)
        picked[dy] = choice
    rows = rows.select(*keys, "y", "x0", "line", *[c.alias(f"p{dy + far}") for dy, c in picked.items()])

    def total(i: Column) -> Column:
        width = F.size("line").cast("long")
        return sum((F.get(F.col(f"p{dy + far}"), edge(i.cast("long") + dx, width).cast("int")) * w for (dy, dx), w in sorted(weights.items())), F.lit(0.0))

    rows = rows.withColumn("new", F.transform(F.sequence(F.lit(0), F.size("line") - 1), total))
    flat = rows.select(*keys, "y", "x0", F.posexplode(F.arrays_zip("line", "new")).alias("i", "s"))
    return flat.select(*keys, "y", (F.col("x0") + F.col("i")).cast("long").alias("x"), F.col("s.line").alias("v"), F.col("s.new").alias(out))


def smooth_dc(dc: DataFrame, steps: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adaptive smoothing of three channels (columns c0, c1, c2 by image_id, y, x) inside the border: each moves
    toward its 3x3 mean by a factor that falls from 1 to 0 as the largest change, in steps, grows to 3/4."""
    line, column = Window.partitionBy("image_id", "_band", "y").orderBy("x"), Window.partitionBy("image_id", "_band", "x").orderBy("y")
    out = banded(dc, ("image_id",), above=1, below=1)
    names = ("c0", "c1", "c2")
    out = out.select("*", *[f(c).over(column).alias(f"{c}_{k}") for c in names for k, f in (("u", F.lag), ("d", F.lead))])
    sides = {"l": F.lag, "r": F.lead}
    out = out.select("*", *[f(f"{c}{v}").over(line).alias(f"{c}{v}_{k}") for c in names for v in ("", "_u", "_d") for k, f in sides.items()]).where("_own")
    smooth = {c: SMOOTHING[0] * F.col(c) + SMOOTHING[1] * ((F.col(f"{c}_u") + F.col(f"{c}_d")) + (F.col(f"{c}_l") + F.col(f"{c}_r"))) + SMOOTHING[2] * ((F.col(f"{c}_u_l") + F.col(f"{c}_u_r")) + (F.col(f"{c}_d_l") + F.col(f"{c}_d_r"))) for c in names}
    gap = F.greatest(*[F.abs(F.col(c) - smooth[c]) / s for c, s in zip(names, steps, strict=True)])
    inside = F.col("c0_u_l").isNotNull() & F.col("c0_d_r").isNotNull()
    factor = F.when(inside, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 3 - 4 * gap))).otherwise(0.0)
    return out.select("image_id", "y", "x", *[(F.col(c) + F.when(inside, (smooth[c] - F.col(c)) * factor).otherwise(0.0)).alias(c) for c in names])
