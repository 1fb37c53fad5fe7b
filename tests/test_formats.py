import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselune.functions import codes
from tesselune.operators import blocks, jpeg, layout, reconstruction, smallblocks, transforms
from tesselune.sources import rasters


def test_estimates_are_near_and_worked_out_by_hand(spark):
    rows = spark.createDataFrame([(q,) for q in [*range(-300, 301), 65535, 1 << 20]], "q long").select("q", codes.reciprocal_estimate(F.col("q")).alias("e")).collect()
    got = {r.q: r.e for r in rows}
    assert got[0] == float("inf") and all(abs(e * q - 1) < 1 / 256 for q, e in got.items() if q)
    assert got[1] == 0.5 * (1 + 255 / 256) and got[3] == 0.25 * (1 + 85 / 256) and got[-2] == -got[2]


def test_counts_kept(spark):
    rows = spark.createDataFrame([(c,) for c in range(0, 300)], "c long").select("c", *(codes.count_kept(F.col("c"), s).alias(f"k{s}") for s in (0, 13))).collect()
    for r in rows:
        assert r.k13 == r.c and r.k0 <= r.c and r.k0 == (r.c if r.c < 2 else 1 << (r.c.bit_length() - 1))


def test_roles_and_checks(spark):
    raster = rasters.closed_form(spark, 8, 2, F.col("x") + 10 * F.col("y"))
    got = {(r.channel, r.y, r.x): r.v for r in layout.planes_by_role(raster, "bgra", "ra").collect()}
    assert got == {(0, 0, 0): 2, (0, 0, 1): 6, (1, 0, 0): 3, (1, 0, 1): 7, (0, 1, 0): 12, (0, 1, 1): 16, (1, 1, 0): 13, (1, 1, 1): 17}
    with pytest.raises(ValueError):
        layout.planes_by_role(raster, "bgr", "ra")
    assert layout.checked(raster, 5).count() == 16
    with pytest.raises(Exception, match="out of range at 1, 6"):
        layout.checked(raster, 4).where("x = 6").collect()


@pytest.mark.parametrize("strategy", [0, 1, 2, 3, 4, 5, 6, 7, 12, 13, 18])
def test_blocks_come_back_from_their_own_coefficients(spark, strategy):
    """Two blocks of a strategy, transformed, quantised without loss of size, and put together again."""
    w, h = transforms.LARGE[strategy][1] if strategy in transforms.LARGE else 8, transforms.LARGE[strategy][0] if strategy in transforms.LARGE else 8
    x, y, c = F.col("x"), F.col("y"), F.col("channel")
    samples = rasters.closed_form(spark, 2 * w, h, (x * 7 + y * 13 + x * y) % 61).withColumn("channel", F.explode(F.array(*map(F.lit, range(3)))))
    samples = samples.withColumn("v", F.col("v") * (1 + c))
    coefs = smallblocks.small_coefficients(samples, reconstruction.SMALL[strategy]) if strategy in reconstruction.SMALL else transforms.coefficients(samples, h, w)
    placed = spark.createDataFrame([("closed", 0, strategy, 0, 0, 1), ("closed", 1, strategy, 0, w // 8, 1)], "image_id string, block long, strategy long, y long, x long, quantisation long")
    fine = coefs.select("image_id", "channel", F.col("bx").alias("block"), F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"), F.round(F.col("coef") * 1000).cast("long").alias("q"))
    cells = transforms.cell_plane(samples, h, w) if strategy in transforms.LARGE else coefs.where("v = 0 AND u = 0").select("image_id", "channel", F.col("by").alias("y"), F.col("bx").alias("x"), F.col("coef").alias("v"))
    ones = spark.range(h * w).selectExpr(f"{strategy}L AS strategy", f"CAST(id div {w} AS int) AS v", f"CAST(id % {w} AS int) AS u", "1000D AS weight", "explode(array(0, 1, 2)) AS channel")
    none = spark.createDataFrame([], "image_id string, ty long, tx long, fx double, fb double")
    out = reconstruction.reconstruct(fine, placed, cells, ones, none).collect()
    want = {(r.channel, r.y, r.x): r.v for r in samples.collect()}
    assert len(out) == len(want) == 6 * w * h and max(abs(r.v - want[r.channel, r.y, r.x]) for r in out) < 0.7


def test_corner_strategies_are_refused_and_missing_cells_are_zero(spark):
    one = lambda s: spark.createDataFrame([("i", 0, s, 0, 0, 1)], "image_id string, block long, strategy long, y long, x long, quantisation long")
    cells = spark.createDataFrame([("i", 0, 0, 0, 8.0)], "image_id string, channel int, y long, x long, v double")
    coefs = spark.createDataFrame([("i", 0, 0, 0, 1, 2)], "image_id string, channel int, block long, v int, u int, q long")
    weights = spark.createDataFrame([(s, 0, 0, 1, 2.0) for s in (0, 14)], "strategy long, channel int, v int, u int, weight double")
    none = spark.createDataFrame([], "image_id string, ty long, tx long, fx double, fb double")
    flat = reconstruction.reconstruct(coefs.limit(0), one(0), cells, weights, none).collect()
    assert len(flat) == 64 and all(abs(r.v - 8) < 1e-9 for r in flat)
    wave = {(r.y, r.x): r.v for r in reconstruction.reconstruct(coefs, one(0), cells.limit(0), weights, none).collect()}
    assert abs(wave[3, 0] - (2 - 0.145 / 2) / 2 * np.sqrt(2) * np.cos(np.pi / 16)) < 1e-9
    with pytest.raises(Exception, match="no transform"):
        reconstruction.reconstruct(coefs, one(14), cells, weights, none).collect()
    assert blocks.natural_order(spark).count() == 64


def test_flat_jpeg_blocks_and_chroma_repeated(spark):
    """A mean of q steps of 8 is q above the middle; chroma of one block covers four of luma."""
    rows = [("i", 0, y, x, v, u, (3 + 2 * y + x if v + u == 0 else 0)) for y in (0, 1) for x in (0, 1) for v in range(8) for u in range(8)]
    rows += [("i", c, 0, 0, v, u, (c if v + u == 0 else 0)) for c in (1, 2) for v in range(8) for u in range(8)]
    coefs = spark.createDataFrame(rows, "image_id string, channel int, by long, bx long, v int, u int, q long")
    steps = spark.createDataFrame([(c, v, u, 8) for c in range(3) for v in range(8) for u in range(8)], "channel int, v int, u int, step int")
    factors = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 2, 2)], "channel int, across int, down int")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in jpeg.pixels(coefs, steps, factors, 15, 13).collect()}
    assert len(got) == 15 * 13 and got[0, 0] == (134, 129, 133) and got[12, 14] == (137, 132, 136)
    assert jpeg.pixels(coefs.limit(0), steps, factors, 15, 13).count() == 0
