import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselune.operators import placement, transforms
from tesselune.sources import rasters


@pytest.mark.parametrize("shape", list(transforms.LARGE.values()))
def test_forward_and_back_and_cells(spark, shape):
    rows, columns = shape
    x, y = F.col("x"), F.col("y")
    raster = rasters.closed_form(spark, 2 * columns + 3, rows + 5, (x * 37 + y * 11 + x * y) % 251)
    value = lambda a, b: (b * 37 + a * 11 + a * b) % 251
    whole = np.array([[value(a, b) for b in range(2 * columns)] for a in range(rows)], float)
    coefs = transforms.coefficients(raster, rows, columns)
    got = np.zeros((2, rows, columns))
    for r in coefs.collect():
        got[r.bx, r.v, r.u] = r.coef
        assert r.place == (r.u * rows + r.v if rows >= columns else r.v * columns + r.u)
    wave = lambda n: np.array([[(1 if k == 0 else 2**0.5) / n * np.cos((2 * i + 1) * k * np.pi / (2 * n)) for i in range(n)] for k in range(n)])
    for b in (0, 1):
        assert np.allclose(got[b], wave(rows) @ whole[:, b * columns : (b + 1) * columns] @ wave(columns).T)
    back = {(r.y, r.x): r.v for r in transforms.block_samples(coefs, rows, columns).collect()}
    assert len(back) == 2 * rows * columns and all(abs(v - whole[a, b]) < 1e-9 for (a, b), v in back.items())
    lows = transforms.low_frequencies(transforms.cell_plane(raster, rows, columns), rows, columns).collect()
    assert len(lows) == 2 * rows * columns // 64 and all(abs(r.coef - got[r.bx, r.v, r.u]) < 1e-9 for r in lows)


def test_a_flat_block_has_flat_cells(spark):
    cells = transforms.cell_plane(rasters.closed_form(spark, 64, 64, F.lit(7)), 64, 64).collect()
    assert len(cells) == 64 and all(abs(r.v - 7) < 1e-9 for r in cells)
    assert transforms.coefficients(rasters.closed_form(spark, 7, 7, F.lit(7)), 8, 16).count() == 0


def test_placement_and_its_faults(spark):
    maps = {1: (2, 2, [0, 0, 0, 0]), 2: (4, 2, [4, 4]), 3: (3, 2, [0, 4]), 4: (2, 2, [5]), 5: (2, 2, [4, 0]), 6: (2, 2, [6]), 7: (3, 2, [6, 0, 4]), 8: (1, 1, [77]), 9: (3, 2, [0, 6, 0, 7])}
    rows = spark.createDataFrame([(m, i, k, 300 * i - 5) for m, (_, _, ks) in maps.items() for i, k in enumerate(ks)], "image_id long, i long, strategy long, raw long")
    images = spark.createDataFrame([(m, w, h) for m, (w, h, _) in maps.items()], "image_id long, width long, height long")
    got = {r.image_id: (r.status, r.placed, r.size) for r in placement.map_status(rows, images).collect()}
    assert got == {1: ("ok", 4, 256), 2: ("ok", 2, 512), 3: ("incomplete", 2, 320), 4: ("bounds", 0, 0), 5: ("full", 1, 256), 6: ("incomplete", 1, 128), 7: ("bounds", 2, 192), 8: ("bounds", 0, 0), 9: ("overlap", 3, 256)}
    at = {(r.image_id, r.i): (r.x, r.y, r.w, r.h, r.quantisation, r.offset) for r in placement.placements(rows, images).collect()}
    assert at[2, 1] == (2, 0, 2, 2, 256, 256) and at[1, 3] == (1, 1, 1, 1, 256, 192) and at[1, 0][4] == 1
