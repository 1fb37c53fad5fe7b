"""Blocks of unequal size placed into an image's cells, each into the first that is free.

Cells fill from the top, so what is taken of a column is told by one number: the state of an image is as wide as
the image, whatever its height, and images stream through a task in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselune.operators.transforms import LARGE
from tesselune.session import ready

#: Width and height in cells of the strategies, by identifier.
CELLS = {k: (1, 1) for k in (0, 1, 2, 3, 12, 13, 14, 15, 16, 17)} | {k: (columns // 8, rows // 8) for k, (rows, columns) in LARGE.items()}
_SCHEMA = "image_id long, height long, i long, strategy long, x long, y long, w long, h long, quantisation long, offset long, status string"


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (image_id, i, strategy, raw, width, height) sorted by image and i to placements and, by image, a last row with its status."""
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = [pa.int64()] * 10 + [pa.string()]
    current, begun, tops, size, placed, status, height = None, False, [], 0, 0, "ok", 0

    def ended() -> tuple:
        whole = "incomplete" if status == "ok" and tops and min(tops) < height else status
        return current, height, placed, None, None, None, None, None, None, size, whole

    for batch in batches:
        rows: list[tuple] = []
        for image, _, strategy, raw, width, tall in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or image != current:
                if begun:
                    rows.append(ended())
                current, begun, tops, size, placed, status, height = image, True, [0] * width, 0, 0, "ok", tall
            if status != "ok":
                continue
            y = min(tops) if tops else height
            if y >= height:
                status = "full"
                continue
            x, (w, h) = tops.index(y), CELLS.get(strategy, (0, 0))
            if not w or x + w > width or y + h > height:
                status = "bounds"
            elif max(tops[x : x + w]) > y:
                status = "overlap"
            else:
                tops[x : x + w] = [y + h] * w
                rows.append((image, height, placed, strategy, x, y, w, h, max(1, min(256, (raw or 0) + 1)), size, None))
                placed, size = placed + 1, size + 64 * w * h
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(ended(), kinds, strict=True)], names)


def _filled(rows: DataFrame, images: DataFrame) -> DataFrame:
    ready(rows.sparkSession)
    both = rows.select("image_id", "i", "strategy", "raw").join(images.select("image_id", "width", "height"), "image_id")
    both = both.repartition("image_id").sortWithinPartitions("image_id", "i")
    return both.select("image_id", "i", "strategy", "raw", "width", "height").mapInArrow(_fill, _SCHEMA)


def placements(rows: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, i, strategy, x, y, w, h, quantisation, offset) of the blocks placed before an image fails, if it does.

    rows (image_id, i, strategy, raw) in order of i take the first free cell each, in lines from the top left; images
    have their width and height in cells. quantisation is raw + 1, between 1 and 256; offset counts the coefficients
    before.
    """
    out = _filled(rows, images).where("status IS NULL")
    return out.select("image_id", "i", "strategy", "x", "y", "w", "h", "quantisation", "offset")


def map_status(rows: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, height, status, placed, size), a row for each image with blocks.

    status: ok; bounds, a block beyond the image or of an unknown strategy; overlap, over cells that are taken; full, blocks
    beyond the last cell; incomplete, cells left free. placed and size count blocks and coefficients up to there.
    """
    out = _filled(rows, images).where("status IS NOT NULL")
    return out.select("image_id", "height", "status", F.col("i").alias("placed"), F.col("offset").alias("size"))
