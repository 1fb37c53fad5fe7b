from pyspark.sql import functions as F

from tesselune.operators import layout, neighbours, ranges, recurrences, stencils, tiles
from tesselune.operators.weighted import weighted_residuals, weighted_samples
from tesselune.sources import rasters


def plane(df, value="v"):
    return sorted((r.image_id, r.y, r.x, r[value]) for r in df.collect())


def test_weighted_predictor_learns_a_ramp_and_comes_back(spark):
    ramp = rasters.closed_form(spark, 40, 30, 3 * F.col("x") + 7 * F.col("y"))
    residuals = weighted_residuals(ramp, 64)
    inside = residuals.where("x > 4 AND y > 4").agg(F.max(F.abs("residual")).alias("m")).first().m
    assert inside <= 3  # the guess is kept below the largest neighbour, which lies 3 short
    assert plane(weighted_samples(residuals, 64)) == plane(ramp)
    grey = rasters.grey12(spark, 33, 21)
    assert plane(weighted_samples(weighted_residuals(grey, 16), 16)) == plane(grey)


def test_squeeze_of_odd_lines_and_one_sample(spark):
    for width in (1, 2, 3, 17):
        grey = rasters.grey12(spark, width, 5)
        assert plane(recurrences.unsqueeze(recurrences.squeeze(grey))) == plane(grey)


def test_edges_are_kept_where_sigma_is_small(spark):
    flat = rasters.closed_form(spark, 20, 20, F.lit(0)).select("image_id", "y", "x", *[F.rand(3).alias(f"c{k}") for k in range(3)], F.lit(0.0).alias("sigma"), F.lit(20).alias("height"), F.lit(20).alias("width"))
    flat = flat.cache()
    assert plane(tiles.preserve_edges(flat, 0, 8), "c1") == plane(flat, "c1")
    a, b = (plane(tiles.preserve_edges(flat.withColumn("sigma", F.lit(3.0)), 1, size), "c1") for size in (8, 24))
    assert all(abs(p[3] - q[3]) < 1e-12 for p, q in zip(a, b, strict=True))


def test_neighbours_of_one_sample_and_no_samples(spark):
    one = neighbours.neighbours(rasters.closed_form(spark, 1, 1, F.lit(9))).first()
    assert (one.w, one.n, one.nw, one.ne, one.ww, one.nn) == (0,) * 6
    assert neighbours.neighbours(rasters.closed_form(spark, 1, 1, F.lit(9)).limit(0)).count() == 0


def test_parts_with_a_gap_or_a_repeat_are_not_complete(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 2, "c"), (3, 0, "a"), (3, 0, "a"), (4, 1, "z")]
    got = {r.k: (r.complete, r.joined) for r in layout.joined_parts(spark.createDataFrame(rows, "k int, s int, p string"), "k", "s", "p").collect()}
    assert got == {1: (True, "ab"), 2: (False, "ac"), 3: (False, "aa"), 4: (False, "z")}


def test_the_final_part_alone_bears_the_flag(spark):
    rows = [(1, 0, "a", False), (1, 1, "b", True), (2, 0, "a", True), (2, 1, "b", True), (3, 0, "a", True), (3, 1, "b", False), (4, 0, "z", None)]
    got = {r.k: r.complete for r in layout.joined_parts(spark.createDataFrame(rows, "k int, s int, p string, fin boolean"), "k", "s", "p", last="fin").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def dealt_by_band(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" not in plan and "_band" in plan.split("hashpartitioning(", 1)[1].split(")")[0]


def test_a_large_image_is_dealt_out_by_bands(spark):
    tall = rasters.closed_form(spark, 3, 2000, (F.col("x") * 7 + F.col("y") * 3) % 251)
    near = neighbours.neighbours(tall)
    assert dealt_by_band(near)
    value = lambda y, x: (x * 7 + y * 3) % 251
    for r in near.where("y IN (63, 64, 65, 127, 128, 129) AND x = 1").collect():
        assert (r.n, r.nn, r.nw, r.ne, r.w) == (value(r.y - 1, 1), value(r.y - 2, 1), value(r.y - 1, 0), value(r.y - 1, 2), value(r.y, 0))
    soft = stencils.stencil(tall, stencils.sharpen_weights(), stencils.mirrored)
    assert dealt_by_band(soft)
    got = {r.y: r.filtered for r in soft.where("x = 1").collect()}
    at = lambda k, n: -k - 1 if k < 0 else 2 * n - 1 - k if k >= n else k
    for y in (0, 1, 62, 63, 64, 65, 1998, 1999):
        want = sum(w * value(at(y + dy, 2000), at(1 + dx, 3)) for (dy, dx), w in stencils.sharpen_weights().items())
        assert abs(got[y] - want) < 1e-9


def test_sums_before_a_row_across_ranges(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 50 = 1, 7, id % 3)) AS k", "id AS o", "id % 11 AS s")
    for most in (100, 1000, 1 << 20):  # all keys cut; those of many rows; none
        total = {}
        got = sorted(ranges.before(rows, ("k",), "o", F.col("s"), most).collect(), key=lambda r: r.o)
        assert len(got) == 5000
        for r in got:
            assert r._before == total.get(r.k, 0)
            total[r.k] = total.get(r.k, 0) + r.s
        whole = sorted(ranges.before(rows, (), "o", F.col("s"), most).collect(), key=lambda r: r.o)
        assert [r._before for r in whole] == [sum(i % 11 for i in range(r.o)) for r in whole]
        assert ranges.before(rows.limit(0), ("k",), "o", F.col("s"), most).count() == 0


def test_a_hot_key_is_cut_into_ranges(spark):
    rows = spark.range(3000).selectExpr("IF(id < 2900, 0, id) AS k", "id AS o", "1L AS s")
    plan = lambda most: ranges.before(rows, ("k",), "o", F.col("s"), most)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan(500) and "_part" not in plan(1 << 20)


def test_octiles_and_move_to_front(spark):
    from tesselune.operators import entropy

    rows = [(k, (i * i + k) % 9) for k in range(3) for i in range(50 + k)]
    got = {(r.k0, r.k): r.threshold for r in entropy.octiles(spark.createDataFrame(rows, "k0 int, v int"), "k0", "v").collect()}
    for k in range(3):
        own = sorted(v for j, v in rows if j == k)
        assert [got[k, i] for i in range(1, 8)] == [own[len(own) * i // 8] for i in range(1, 8)]
    places = spark.createDataFrame([(u, o, (u * 7 + o * 5) % 6) for u in range(4) for o in range(30)], "u long, o long, place long")
    for u in range(4):
        symbols, want = list(range(6)), []
        for o in range(30):
            want.append(symbols.pop((u * 7 + o * 5) % 6))
            symbols.insert(0, want[-1])
        assert [r.symbol for r in recurrences.unmove_to_front(places.where(F.col("u") == u), "u", "o", 6).orderBy("o").collect()] == want


def test_classes_and_slices_of_channels(spark):
    rows = [(1, 0, 9000, 9000, 0, 0, True), (1, 1, 100, 100, 3, 3, False), (1, 2, 300, 10, 0, 0, False), (1, 3, 40, 20, 3, 4, False), (1, 4, 70, 129, 1, -1, False), (2, 0, 5, 5, 0, 0, False)]
    channels = spark.createDataFrame(rows, "image_id int, channel int, width int, height int, hshift int, vshift int, meta boolean")
    assert [r.kind for r in layout.channel_classes(channels, 128).orderBy("image_id", "channel").collect()] == ["global", "global", "ac", "dc", "ac", "global"]
    got = sorted(tuple(r) for r in layout.group_slices(channels, 128).collect())
    want = [(1, 2, "ac", 0, g, 0, 128 * g, 10, w) for g, w in ((0, 128), (1, 128), (2, 44))] + [(1, 3, "dc", 0, 0, 0, 0, 20, 40)]
    want += [(1, 4, "ac", gy, gx, 128 * gy, 64 * gx, h, w) for gy, h in ((0, 128), (1, 1)) for gx, w in ((0, 64), (1, 6))]
    assert got == sorted(want)
