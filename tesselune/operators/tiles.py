"""Filters that need a pixel's wider surroundings: tiles with a halo, each a group of bounded size.

A pixel goes to its own tile and to those whose halo it lies in, so one shuffle brings a tile and its
surroundings together; the filter runs in numpy over the tile as an array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselune.session import ready

#: Neighbours of the first pass, of the others, and the cross over which patches are compared.
FIRST = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1), (0, -2), (0, 2), (-2, 0), (2, 0))
SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))
CROSS = ((0, 0), *SIDES)
#: Weights of the channels in a difference, sigma's factor by pass, border factor, sigma's units.
CHANNELS, SIGMA_SCALE, BORDER, SIGMA_UNIT, QUANT_FACTOR = (40.0, 5.0, 3.5), (1.65, 1.0, 0.65), 2 / 3, 1.1715728752538099, 0.27878788


def halo_tiles(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Adds tile (ty, tx), a row for each tile whose halo holds the pixel."""
    near = F.array(F.lit(-halo), F.lit(halo))

    def tiles(at: str):
        return F.array_distinct(F.transform(near, lambda d: F.floor((F.col(at) + d) / size)))

    return pixels.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))


def block_sigma(quant: float | Column, sharpness: int, global_scale: int = 4096) -> float | Column:
    """A block's sigma from its quantiser and sharpness 0 to 7."""
    return 65536.0 / global_scale / quant * QUANT_FACTOR * sharpness / 7


def preserve_edges(pixels: DataFrame, step: int, size: int = 64) -> DataFrame:
    """One pass of the edge-preserving filter over (image_id, y, x, c0, c1, c2, sigma, height, width).

    Each pixel becomes the mean of itself and its neighbours, weighted by how like the patches around them
    are, less where sigma is small and at edges of 8 x 8 blocks; pixels of sigma up to 1e-6 stay. Images are
    mirrored at their edges; size must be a multiple of 8.
    """
    ready(pixels.sparkSession)
    halo, scale = 3, SIGMA_SCALE[step]
    offsets, cross = (FIRST if step == 0 else SIDES), (((0, 0),) if step == 2 else CROSS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ty, tx = key[1].as_py(), key[2].as_py()
        y, x = (table.column(c).to_numpy() for c in "yx")
        height, width = (table.column(c)[0].as_py() for c in ("height", "width"))
        side = size + 2 * halo
        grid = np.zeros((4, side, side))
        for k, c in enumerate(("c0", "c1", "c2", "sigma")):
            grid[k, y - ty * size + halo, x - tx * size + halo] = table.column(c).to_numpy()

        def mirrored(start: int, length: int) -> np.ndarray:
            at = np.arange(start - halo, start + size + halo)
            at = np.where(at < 0, -at - 1, np.where(at >= length, 2 * length - 1 - at, at))
            return np.clip(at - start + halo, 0, side - 1)

        rows, columns = mirrored(ty * size, height), mirrored(tx * size, width)
        full = grid[:, rows][:, :, columns]

        def shifted(dy: int, dx: int) -> np.ndarray:
            # a coordinate outside is mirrored once, from where the sum of its offsets lands
            return full[:3, halo + dy : halo + dy + size, halo + dx : halo + dx + size]

        centre, sigma = shifted(0, 0), full[3, halo : halo + size, halo : halo + size] * scale
        line = np.arange(size) % 8
        edge = (line == 0) | (line == 7)
        factor = np.where(edge[:, None] | edge[None, :], BORDER, 1.0)
        inverse = SIGMA_UNIT * factor / np.maximum(sigma, 1e-9)
        weights, total = np.ones((size, size)), centre.copy()
        for dy, dx in offsets:
            sad = sum(np.tensordot(CHANNELS, np.abs(shifted(cy, cx) - shifted(dy + cy, dx + cx)), 1) for cy, cx in cross)
            w = np.maximum(0, 1 - sad * inverse)
            weights += w
            total += w * shifted(dy, dx)
        out = np.where(sigma > 1e-6, total / weights, centre)
        own = (y // size == ty) & (x // size == tx)
        oy, ox = y[own], x[own]
        values = out[:, oy - ty * size, ox - tx * size]
        return pa.table({"image_id": pa.array([key[0].as_py()] * len(oy), pa.string()), "y": oy, "x": ox, **{f"c{k}": values[k] for k in range(3)}})

    schema = "image_id string, y long, x long, c0 double, c1 double, c2 double"
    return halo_tiles(pixels, size, halo).groupBy("image_id", "ty", "tx").applyInArrow(run, schema)
