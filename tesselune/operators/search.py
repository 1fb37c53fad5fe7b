"""The cheapest division of 64 x 64 tiles into transforms, from the smallest blocks up.

Costs of all blocks of a shape are one pass over the samples; a level then weighs, for each parent, its own transform
against its four children's best and against halves across and along. No tile is searched by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselune.operators import smallblocks, transforms

#: A block's cost by nonzeros, their size and the block itself; what shapes other than squares cost more.
NONZERO, SIZE, BLOCK, OBLONG = 3.5, 0.25, 1.0, 0.5
#: A single cell dearer than this is tried in other ways; a square no dearer than this is left whole; what another way must save.
TRIED, WHOLE, SAVED = 6.5, 1.25, 0.5
#: Identifiers of the ways to transform one cell beside the plain one, in the order in which they are tried.
WAYS = {"hornuss": 1, "dct2x2": 2, "dct4x4": 3, "dct4x8": 12, "dct8x4": 13}
_SHAPE = {shape: k for k, shape in transforms.LARGE.items()} | {(8, 8): 0}


def _summed(coefs: DataFrame, low: Column, scale: float) -> DataFrame:
    """(image_id, y, x, q) of the coefficients beside the lowest, quantised."""
    return coefs.where(~low).select("image_id", F.col("by").alias("y"), F.col("bx").alias("x"), F.round(F.round("coef", 6) * scale).alias("q"))


def block_costs(samples: DataFrame, rows: int, columns: int, scale: float = 0.1, cell_scale: float = 1.0, main: int = 0, way: str | None = None) -> DataFrame:
    """(image_id, y, x, cost) of each full block of rows x columns, by its number down and across; channels count together.

    The cost: 3.5 a nonzero quantised coefficient, a quarter of its size, 1, half more if the block is not square; if it
    covers several cells, also the spread of the main channel's cells times their number, and its nonzeros times its
    width and height in cells. ``scale`` quantises coefficients, ``cell_scale`` cells.
    """
    down, across = rows // 8, columns // 8
    coefs = smallblocks.small_coefficients(samples, way) if way else transforms.coefficients(samples, rows, columns)
    parts = _summed(coefs, (F.col("v") < down) & (F.col("u") < across), scale).withColumn("cell", F.lit(None).cast("double"))
    if down * across > 1:
        cells = transforms.cell_plane(samples.where(F.col("channel") == main), rows, columns)
        cells = cells.select("image_id", F.floor(F.col("y") / down).alias("y"), F.floor(F.col("x") / across).alias("x"), F.lit(None).cast("double").alias("q"), F.round(F.round("v", 6) * cell_scale).alias("cell"))
        parts = parts.unionByName(cells)
    per = parts.groupBy("image_id", "y", "x").agg(F.count_if(F.col("q") != 0).alias("n"), F.sum(F.abs("q")).alias("size"), (F.max("cell") - F.min("cell")).alias("spread"))
    cost = NONZERO * F.col("n") + SIZE * F.col("size") + BLOCK + (0.0 if rows == columns or way else OBLONG)
    if down * across > 1:
        cost = cost + F.col("spread") * (down * across) + F.col("n") * (down + across)
    return per.select("image_id", "y", "x", cost.cast("double").alias("cost"))


def _leaf(strategy: Column, rows: int, columns: int, y: Column, x: Column) -> Column:
    at = {"strategy": strategy, "y": y * (rows // 8), "x": x * (columns // 8), "h": F.lit(rows // 8), "w": F.lit(columns // 8)}
    return F.struct(*(c.cast("long").alias(k) for k, c in at.items()))


def single_cells(samples: DataFrame, ways: tuple[str, ...] = tuple(WAYS), **scales: float) -> DataFrame:
    """(image_id, y, x, cost, leaves) of each cell: the plain transform, or, if that is dear, what saves enough in turn."""
    rows = block_costs(samples, 8, 8, **scales).withColumn("way", F.lit(0))
    for way in ways:
        rows = rows.unionByName(block_costs(samples, 8, 8, way=way, **scales).withColumn("way", F.lit(WAYS[way])))
    tried = rows.groupBy("image_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("way", "cost"))).alias("t"))
    better = lambda a, b: F.when((F.get("t", F.lit(0))["cost"] > TRIED) & (b["cost"] + SAVED < a["cost"]), b).otherwise(a)
    best = F.aggregate(F.slice("t", F.lit(2), F.size("t")), F.get("t", F.lit(0)), better)
    out = tried.select("image_id", "y", "x", best.alias("b"))
    return out.select("image_id", "y", "x", F.col("b.cost").alias("cost"), F.array(_leaf(F.col("b.way"), 8, 8, F.col("y"), F.col("x"))).alias("leaves"))


def _level(samples: DataFrame, children: DataFrame, n: int, **scales: float) -> DataFrame:
    """(image_id, y, x, cost, leaves) of the blocks of n x n from those of half the size."""

    def parents(rows: DataFrame, kind: int, down: int, across: int) -> DataFrame:
        at = rows.select("image_id", F.floor(F.col("y") / down).alias("py"), F.floor(F.col("x") / across).alias("px"), "cost", "leaves", F.struct("y", "x", "leaves").alias("own"))
        out = at.groupBy("image_id", "py", "px").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list("own")).alias("own"))
        return out.where(F.col("n") == down * across).select("image_id", F.col("py").alias("y"), F.col("px").alias("x"), F.struct(F.lit(kind).alias("kind"), "cost", F.flatten(F.col("own.leaves")).alias("leaves")).alias("o"))

    def whole(rows: int, columns: int) -> DataFrame:
        costs = block_costs(samples, rows, columns, **scales)
        return costs.withColumn("leaves", F.array(_leaf(F.lit(_SHAPE[rows, columns]), rows, columns, F.col("y"), F.col("x"))))

    options = parents(whole(n, n), 0, 1, 1)
    for o in (parents(children, 1, 2, 2), parents(whole(n // 2, n), 2, 2, 1), parents(whole(n, n // 2), 3, 1, 2)):
        options = options.unionByName(o)
    per = options.groupBy("image_id", "y", "x").agg(F.array_sort(F.collect_list("o")).alias("o")).where(F.size("o") == 4)
    first = F.get("o", F.lit(0))
    best = F.when(first["cost"] <= WHOLE, first).otherwise(F.aggregate(F.slice("o", F.lit(2), F.lit(3)), first, lambda a, b: F.when(b["cost"] < a["cost"], b).otherwise(a)))
    out = per.select("image_id", "y", "x", best.alias("b"))
    return out.select("image_id", "y", "x", F.col("b.cost").alias("cost"), F.col("b.leaves").alias("leaves"))


def search_tiles(samples: DataFrame, largest: int = 64, ways: tuple[str, ...] = tuple(WAYS), **scales: float) -> DataFrame:
    """(image_id, y, x, cost, leaves) of each full tile of ``largest`` (16, 32 or 64) samples a side.

    leaves: an array of (strategy, y, x, h, w) in cells. A parent's options are tried in the order whole, four children, two halves
    one over the other, two side by side; a later one must cost less. Tiles that lack samples are left out.
    """
    rows = single_cells(samples, ways, **scales)
    n = 16
    while n <= largest:
        rows = _level(samples, rows, n, **scales)
        n *= 2
    return rows
