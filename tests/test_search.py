import itertools
import random

from pyspark.sql import functions as F

from tesselune.operators import search
from tesselune.operators.codelengths import bounded_lengths, code_lengths_bounded
from tesselune.sources import rasters


def cheapest(counts, longest):
    """The least cost of a complete code, over all lengths."""
    best = None
    for lengths in itertools.product(range(1, longest + 1), repeat=len(counts)):
        if sum(2 ** (longest - n) for n in lengths) <= 2**longest:
            cost = sum(c * n for c, n in zip(counts, lengths))
            best = cost if best is None else min(best, cost)
    return best


def test_lengths_are_bounded_complete_and_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        counts = [rng.randrange(1, 40) for _ in range(rng.randrange(3, 6))]
        lengths = bounded_lengths(counts, 5)
        assert max(lengths) <= 5 and sum(2 ** (5 - n) for n in lengths) == 32
        assert sum(c * n for c, n in zip(counts, lengths)) == cheapest(counts, 5)
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    for longest in (5, 8, 15):  # depths would reach 29
        lengths = bounded_lengths(fibonacci, longest)
        assert max(lengths) <= longest and sum(2 ** (longest - n) for n in lengths) == 2**longest
        assert sorted(lengths, reverse=True) == lengths or longest == 5
    assert bounded_lengths([7], 15) == [1] and bounded_lengths([7, 1], 15) == [1, 1] and bounded_lengths([], 15) == []


def test_many_histograms(spark):
    rows = [(k, t, (t * 7 + k) % 13) for k in range(5) for t in range(10)]
    got = code_lengths_bounded(spark.createDataFrame(rows, "k int, token int, n int"), "k", longest=6)
    by = {}
    for r in got.collect():
        by.setdefault(r.k, []).append((r.token, r.n, r.len))
    for k, found in by.items():
        want = [(t, n) for j, t, n in rows if j == k and n]
        assert sorted((t, n) for t, n, _ in found) == want
        assert [n for *_, n in sorted(found)] == bounded_lengths([n for _, n in want], 6)
    assert code_lengths_bounded(got.select("k", "token", "n").limit(0), "k").count() == 0


def test_a_flat_tile_is_one_block_and_leaves_cover_each_tile(spark):
    flat = search.search_tiles(rasters.closed_form(spark, 64, 64, F.lit(9))).collect()
    assert [(r.y, r.x, r.cost, [tuple(leaf) for leaf in r.leaves]) for r in flat] == [(0, 0, 1.0, [(18, 0, 0, 8, 8)])]
    x, y = F.col("x"), F.col("y")
    bumpy = F.when(x < 32, 40).when(y < 16, (x * x + y * 7) % 90).otherwise(F.floor(y / 8) * 9)
    for r in search.search_tiles(rasters.closed_form(spark, 70, 128, bumpy), scale=0.3).collect():
        cells = [(leaf.y + a, leaf.x + b) for leaf in r.leaves for a in range(leaf.h) for b in range(leaf.w)]
        assert sorted(cells) == [(r.y * 8 + a, r.x * 8 + b) for a in range(8) for b in range(8)]
        assert len({leaf.strategy for leaf in r.leaves}) > 1
