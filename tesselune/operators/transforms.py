"""Separable transforms of blocks of any size: each block is gathered once, and both axes are matrix products.

A block of rows x columns samples comes together in one shuffle as an array; tasks multiply whole batches of blocks.
Coefficients, their inverse, the low frequencies as a plane of cells and back are all such products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselune.session import ready

#: Rows and columns of the large strategies, by identifier.
LARGE = {4: (16, 16), 5: (32, 32), 6: (16, 8), 7: (8, 16), 8: (32, 8), 9: (8, 32), 10: (32, 16), 11: (16, 32), 18: (64, 64), 19: (64, 32), 20: (32, 64)}


def cosines(n: int) -> np.ndarray:
    """The DCT-II basis by (frequency, place), in which a constant gives its value at frequency 0."""
    k, i = np.mgrid[:n, :n]
    return np.where(k == 0, 1.0, np.sqrt(2)) / n * np.cos((2 * i + 1) * k * np.pi / (2 * n))


def samples_of(n: int) -> np.ndarray:
    """The inverse of ``cosines(n)``."""
    return cosines(n).T * n


def cell_scales(cells: int) -> np.ndarray:
    """By how much a low frequency of a block of ``cells`` cells of 8 samples exceeds that of the cells' means."""
    k = np.arange(cells)[:, None] * np.pi / (4 * cells) / 2 ** np.arange(3)
    return 1 / np.cos(k).prod(1)


def cells_of(cells: int) -> np.ndarray:
    """Samples of an axis of ``8 * cells`` to its cells' values, from the lowest frequencies alone."""
    return samples_of(cells) @ (cosines(8 * cells)[:cells] / cell_scales(cells)[:, None])


def lows_of(cells: int) -> np.ndarray:
    """Cells' values of an axis to the lowest frequencies of a block over them."""
    return cosines(cells) * cell_scales(cells)[:, None]


def _products(left: np.ndarray, right: np.ndarray):
    shape = left.shape[1], right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            made = left @ batch.column(n_keys := batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, *shape) @ right.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(left) * len(right)), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], lists], batch.schema.names)

    return run


def mapped_blocks(samples: DataFrame, left: np.ndarray, right: np.ndarray, value: str = "v", keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """(keys, by, bx, v, u, s): left X right' of each full block X of samples (keys, y, x, value).

    left has a column for each line of a block and a row for each line of the result, right the same for columns.
    Blocks that lack a sample are left out.
    """
    ready(samples.sparkSession)
    rows, columns = left.shape[1], right.shape[1]
    cells = F.struct((F.col("y") % rows * columns + F.col("x") % columns).alias("p"), F.col(value).cast("double").alias("s"))
    at = samples.select(*keys, F.floor(F.col("y") / rows).alias("by"), F.floor(F.col("x") / columns).alias("bx"), cells.alias("c"))
    full = at.groupBy(*keys, "by", "bx").agg(F.array_sort(F.collect_list("c")).alias("c")).where(F.size("c") == rows * columns)
    full = full.select(*keys, "by", "bx", F.col("c.s").alias("s"))
    made = full.mapInArrow(_products(left, right), full.schema)
    out = made.select(*keys, "by", "bx", F.posexplode("s").alias("k", "s"))
    return out.select(*keys, "by", "bx", F.floor(F.col("k") / len(right)).cast("int").alias("v"), (F.col("k") % len(right)).cast("int").alias("u"), "s")


def coefficients(samples: DataFrame, rows: int, columns: int, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """(keys, by, bx, v, u, place, coef) of each full block. place is the coefficient's in its canonical array, in which
    the longer axis lies along lines: of a block as high as wide, or higher, that array is the transposed one."""
    out = mapped_blocks(samples, cosines(rows), cosines(columns), keys=keys)
    place = F.col("u") * rows + F.col("v") if rows >= columns else F.col("v") * columns + F.col("u")
    return out.select(*keys, "by", "bx", "v", "u", place.cast("int").alias("place"), F.col("s").alias("coef"))


def block_samples(coefs: DataFrame, rows: int, columns: int, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """(keys, y, x, v) of coefficients (keys, by, bx, v, u, coef), unrounded."""
    at = coefs.select(*keys, (F.col("by") * rows + F.col("v")).alias("y"), (F.col("bx") * columns + F.col("u")).alias("x"), "coef")
    out = mapped_blocks(at, samples_of(rows), samples_of(columns), "coef", keys)
    return out.select(*keys, (F.col("by") * rows + F.col("v")).alias("y"), (F.col("bx") * columns + F.col("u")).alias("x"), F.col("s").alias("v"))


def cell_plane(samples: DataFrame, rows: int, columns: int, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """(keys, y, x, v): a value for each cell of 8 x 8 samples, from the lowest frequencies of its block of rows x columns."""
    out = mapped_blocks(samples, cells_of(rows // 8), cells_of(columns // 8), keys=keys)
    return out.select(*keys, (F.col("by") * (rows // 8) + F.col("v")).alias("y"), (F.col("bx") * (columns // 8) + F.col("u")).alias("x"), F.col("s").alias("v"))


def low_frequencies(cells: DataFrame, rows: int, columns: int, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """(keys, by, bx, v, u, coef): the lowest coefficients of blocks of rows x columns samples, from the plane of their cells."""
    return mapped_blocks(cells, lows_of(rows // 8), lows_of(columns // 8), keys=keys).withColumnRenamed("s", "coef")
