"""The small transforms of 8 x 8 blocks, each one linear map of 64 samples.

A block's samples come together in one shuffle, as an array of 64; the map is a constant matrix, so all
coefficients are one expression. Inverse transforms use the inverse matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("hornuss", "dct2x2", "dct4x4", "dct4x8", "dct8x4")


def _cosines(n: int) -> np.ndarray:
    """The DCT-II basis by (frequency, place), in which a constant gives its value at frequency 0."""
    k, i = np.mgrid[:n, :n]
    return np.where(k == 0, 1.0, np.sqrt(2)) / n * np.cos((2 * i + 1) * k * np.pi / (2 * n))


def _signs(a: int, b: int) -> np.ndarray:
    """Signs by (below, right) of the four quarters: a changes them to the right, b downward."""
    below, right = np.mgrid[:2, :2]
    return (-1.0) ** (a * right + b * below)


def small_matrix(kind: str) -> np.ndarray:
    """Weights by (8 * coefficient's line + column, 8 * sample's line + column)."""
    m = np.zeros((8, 8, 8, 8))
    four, eight, quarters = _cosines(4), _cosines(8), [(0, 0), (0, 1), (1, 0), (1, 1)]
    if kind == "dct2x2":  # means of quarters over quarters, with what tells the quarters apart at each size
        m[0, 0] = 1 / 64
        for cell in (1, 2, 4):
            grid = 4 // cell
            for a, b in quarters[1:]:
                block = np.kron(_signs(a, b), np.ones((cell, cell))) / (4 * cell * cell)
                for y, x in np.ndindex(grid, grid):
                    m[a * grid + y, b * grid + x, 2 * cell * y : 2 * cell * (y + 1), 2 * cell * x : 2 * cell * (x + 1)] = block
        return m.reshape(64, 64)
    if kind in ("dct4x8", "dct8x4"):
        for half in (0, 1):
            own = slice(4 * half, 4 * half + 4)
            if kind == "dct4x8":
                m[half::2, :, own] = np.einsum("vi,uj->vuij", four, eight)
            else:
                m[half::2, :, :, own] = np.einsum("vi,uj->uvij", eight, four)
        low = m[:2, 0].copy()
        m[0, 0], m[1, 0] = (low[0] + low[1]) / 2, (low[0] - low[1]) / 2
        return m.reshape(64, 64)
    for y, x in quarters:
        if kind == "dct4x4":
            own = np.einsum("vi,uj->uvij", four, four)
        else:  # differences from one sample, whose own place takes the corner's, as the corner holds the mean
            own = np.eye(16).reshape(4, 4, 4, 4)
            own[1, 1] = own[0, 0]
            own[..., 1, 1] -= 1
            own[0, 0] = 1 / 16
        m[y::2, x::2, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = own
    low = m[:2, :2].copy()
    for a, b in quarters:
        m[a, b] = np.einsum("yx,yxij->ij", _signs(a, b), low) / 4
    return m.reshape(64, 64)


def _mapped(values: Column, matrix: np.ndarray) -> Column:
    # one literal, which Spark folds to an array of doubles
    flat = F.split(F.lit(",".join(map(repr, matrix.ravel().tolist()))), ",").cast("array<double>")
    lines = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.slice(flat, k * 64 + 1, F.lit(64)))
    return F.transform(lines, lambda line: F.aggregate(F.zip_with(line, values, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))


def _blocks(rows: DataFrame, place: Column, value: str, matrix: np.ndarray) -> DataFrame:
    """(image_id, channel, by, bx, k, s): the map of each block that has all of its 64 places."""
    cells = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(value).cast("double").alias("s"))))
    full = rows.groupBy("image_id", "channel", "by", "bx").agg(cells.alias("c")).where(F.size("c") == 64)
    return full.select("image_id", "channel", "by", "bx", F.posexplode(_mapped(F.col("c.s"), matrix)).alias("k", "s"))


def small_coefficients(samples: DataFrame, kind: str) -> DataFrame:
    """(image_id, channel, by, bx, v, u, coef) of each full 8 x 8 block."""
    rows = samples.withColumns({"by": F.floor(F.col("y") / 8), "bx": F.floor(F.col("x") / 8)})
    out = _blocks(rows, F.col("y") % 8 * 8 + F.col("x") % 8, "v", small_matrix(kind))
    return out.select("image_id", "channel", "by", "bx", F.floor(F.col("k") / 8).alias("v"), (F.col("k") % 8).cast("long").alias("u"), F.col("s").alias("coef"))


def small_samples(coefs: DataFrame, kind: str) -> DataFrame:
    """(image_id, channel, y, x, v) of such coefficients, unrounded."""
    out = _blocks(coefs, F.col("v") * 8 + F.col("u"), "coef", np.linalg.inv(small_matrix(kind)))
    return out.select("image_id", "channel", (F.col("by") * 8 + F.floor(F.col("k") / 8)).alias("y"), (F.col("bx") * 8 + F.col("k") % 8).alias("x"), F.col("s").alias("v"))
