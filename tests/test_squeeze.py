import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselune.operators import recurrences
from tesselune.plans import queries
from tesselune.sources import rasters

SAMPLES = "image_id string, channel int, y long, x long, v long"


def odd_raster(spark):
    """Lines and columns of 1 to 41 samples, smooth, noisy and far apart."""
    rng, rows = random.Random(5), []
    for channel, (w, h) in enumerate(((1, 1), (1, 2), (2, 1), (3, 41), (41, 3), (17, 18))):
        rows += [("i", channel, y, x, (rng.randrange(-9, 9), 40 * x - 30 * y, rng.randrange(-10**6, 10**6))[(x + y) % 3]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, SAMPLES).repartition(3)


def samples(df):
    return sorted((r.image_id, r.channel, r.y, r.x, r.v) for r in df.collect())


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_pairs_are_those_of_lines_and_come_back(spark, down, batch):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        raster = odd_raster(spark)
        lines = recurrences.squeeze(raster, down)
        each = lines.select("image_id", "channel", "y", "high", F.posexplode("low").alias("k", "low")).select("channel", "y", "k", "low", F.get("high", F.col("k")).alias("high"))
        pairs = recurrences.squeeze_pairs(raster, down)
        assert sorted(map(tuple, pairs.drop("image_id").collect()), key=str) == sorted(map(tuple, each.collect()), key=str)
        assert samples(recurrences.unsqueeze(lines, down)) == samples(recurrences.unsqueeze_pairs(pairs, down)) == samples(raster)
        assert recurrences.unsqueeze_pairs(pairs.limit(0), down).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_any_pairs_are_made_as_one_after_the_other():
    """Also lows and highs that no samples have."""
    rng = np.random.default_rng(6)
    for spread in (2, 30, 5000):
        low, high = rng.integers(-spread, spread, 400), rng.integers(-spread, spread, 400)
        after, begins = np.append(low[1:], low[-1]), rng.random(400) < 0.02
        first, second = recurrences._samples_of_pairs(low, after, high, begins, 9)
        before = 9
        for k in range(400):
            b = low[k] if begins[k] else before
            one, two = recurrences._samples_of_pairs(low[k : k + 1], after[k : k + 1], high[k : k + 1], np.array([False]), int(b))
            assert (one[0], two[0]) == (first[k], second[k])
            before = two[0]


def test_a_column_is_not_gathered_into_a_row(spark):
    """Columns are as long as the table; a row of one was built anew for each of its pairs."""
    plan = queries.QUERIES["squeeze_columns_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
    raster = rasters.closed_form(spark, 2, 60_001, (F.col("y") * 37 + F.col("x") * 11) % 251)
    back = recurrences.unsqueeze_pairs(recurrences.squeeze_pairs(raster, True), True)
    assert back.join(raster, ["image_id", "channel", "y", "x", "v"]).count() == back.count() == 120_002
