import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselune.operators import recurrences, weighted
from tesselune.operators.weighted import Leaf
from tesselune.sources import rasters


def grid(df, value):
    return {(r.y, r.x): r[value] for r in df.collect()}


def test_errors_worked_out_by_hand(spark):
    """A line of two tens and a thirty, then one of tens.

    First sample: all guesses are 0, so is the prediction; it is wrong by 0 - 80 eighths. Second: n falls back to w = 10, so
    w, n and ne are 80 eighths; the errors are te_w = -80 and none above, of mixed sign, so the prediction is kept between the
    least and the largest of 80 and 80: it is right, and the error property is -80.
    """
    rows = [[10, 10, 30], [10, 10, 10]]
    df = spark.createDataFrame([("i", 0, y, x, v) for y, line in enumerate(rows) for x, v in enumerate(line)], "image_id string, channel int, y long, x long, v long")
    out = weighted.tree_residuals(df, (15, 0, Leaf(6), Leaf(6)), 8)
    residual, error = grid(out, "residual"), grid(out, "error")
    assert (residual[0, 0], residual[0, 1], residual[0, 2]) == (10, 0, 20)
    # third sample: te_w = 0. In the second line te_n, te_nw and te_ne are -80, 0 and -160 in turn
    assert (error[0, 0], error[0, 1], error[0, 2]) == (0, -80, 0)
    assert error[1, 0] == -80 and error[1, 1] == -160
    leaves = grid(out, "leaf")
    assert leaves[0, 0] == 1 and set(leaves.values()) <= {0, 1}


@pytest.mark.parametrize("size", [4, 7, 64])
def test_any_tree_comes_back(spark, size):
    x, y = F.col("x"), F.col("y")
    raster = rasters.closed_form(spark, 23, 18, (x * 31 + y * 17 + x * y * 5) % 211 - 40)
    tree = (15, 12, (10, 4, Leaf(6, 1), Leaf(12)), (2, 2, (3, 1, Leaf(7), Leaf(10, -3)), (14, 0, (1, 65535, Leaf(11), Leaf(13)), Leaf(0))))
    residuals = weighted.tree_residuals(raster, tree, size)
    back = weighted.tree_samples(residuals, tree, size)
    assert grid(back, "v") == grid(raster, "v")
    assert grid(back, "leaf") == grid(residuals, "leaf") and grid(back, "error") == grid(residuals, "error")
    assert len(set(grid(residuals, "leaf").values())) >= 5


def test_multipliers(spark):
    raster = rasters.closed_form(spark, 9, 5, F.col("x") * 6 + F.col("y") * 3)
    residuals = weighted.tree_residuals(raster, Leaf(1, 0, 3), 16)
    assert grid(residuals, "residual")[0, 3] == 2
    assert grid(weighted.tree_samples(residuals, Leaf(1, 0, 3), 16), "v") == grid(raster, "v")
    with pytest.raises(Exception, match="no multiple"):
        weighted.tree_residuals(raster, Leaf(1, 1, 3), 16).collect()


def test_no_samples_and_one(spark):
    one = rasters.closed_form(spark, 1, 1, F.lit(9))
    assert grid(weighted.weighted_residuals(one), "residual") == {(0, 0): 9}
    assert weighted.weighted_residuals(one.limit(0)).count() == 0


def test_tiles_step_as_one_does():
    rng = np.random.default_rng(4)
    tiles = rng.integers(-99, 999, (9, 14, 5))
    none = np.zeros(5, int)
    together = weighted.lockstep(tiles, Leaf(6), False, none, none)[0]
    for k in range(5):
        assert (weighted.lockstep(tiles[:, :, k : k + 1], Leaf(6), False, none[:1], none[:1])[0][:, :, 0] == together[:, :, k]).all()


def test_words_of_the_range_coder_worked_out_by_hand(spark):
    """0x130000 is 405 * 3072 + 1024, so token 1 makes 405 * 4096 + 1024 + 1024 = 0x195800; token 0 makes 1216 * 4096."""
    table = spark.createDataFrame([(0, 1024, 0), (1, 3072, 1024)], "token long, freq long, cum long")
    tokens = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, 0), (3, 1, 1)], "s long, o long, token long")
    got = {r.s: r.words for r in recurrences.rans_sections(tokens, table, "s", "o").collect()}
    assert got == {1: [0x19, 0x5800], 2: [0x4C, 0], 3: [0x65, 0x6000]}


def test_sections_of_unequal_length_come_back(spark):
    table = spark.createDataFrame([(0, 4000, 0), (5, 90, 4000), (9, 6, 4090)], "token long, freq long, cum long")
    rows = [(s, k, (0, 0, 0, 5, 9)[(s * 7 + k * k) % 5]) for s in range(12) for k in range(s * s)]
    tokens = spark.createDataFrame(rows, "s long, o long, token long")
    coded = recurrences.rans_sections(tokens, table, "s", "o")
    got = sorted((r.s, r.place, r.token) for r in recurrences.unrans_sections(coded, table, "s").collect())
    assert got == sorted(rows)
    assert recurrences.rans_sections(tokens.limit(0), table, "s", "o").count() == 0
    broken = coded.withColumn("words", F.transform("words", lambda w: (w + 1) % 65536))
    with pytest.raises(Exception, match="first state"):
        recurrences.unrans_sections(broken, table, "s").collect()
    with pytest.raises(Exception, match="not in the table"):
        recurrences.rans_sections(tokens.withColumn("token", F.lit(4).cast("long")), table, "s", "o").collect()
