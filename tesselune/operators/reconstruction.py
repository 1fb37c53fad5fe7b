"""Samples of images whose blocks are transformed in ways of their own, from quantised coefficients.

All blocks go through one plan: coefficients meet their block and their weight, chroma takes its share of luma by
64-sample tile, cells give the lowest frequencies, and each block's values are gathered in one shuffle. A task sorts
its batch by strategy and multiplies all blocks of a strategy at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselune.operators.blocks import band_weights, dequantise
from tesselune.operators.placement import CELLS
from tesselune.operators.smallblocks import small_matrix
from tesselune.operators.transforms import lows_of, samples_of
from tesselune.session import ready

#: Small transforms by strategy; 14 to 17, of the corner kind, are not here.
SMALL = {1: "hornuss", 2: "dct2x2", 3: "dct4x4", 12: "dct4x8", 13: "dct8x4"}


def strategy_weights(spark: SparkSession, strategies: list[int], bands: dict[int, list[float]]) -> DataFrame:
    """(strategy, channel, v, u, weight) of cosine strategies, from a set of bands for each channel.

    The weights of a shape are those of its shorter axis down and its longer one across, so a block and the one turned share theirs.
    A few rows a coefficient of a strategy: as many as a block has, whatever the images' size.
    """
    out = None
    for strategy in strategies:
        w, h = (8 * n for n in CELLS[strategy])
        for channel, values in bands.items():
            rows = band_weights(spark, values, min(w, h), max(w, h))
            v, u = ("x", "y") if h > w else ("y", "x")
            rows = rows.select(F.lit(strategy).cast("long").alias("strategy"), F.lit(channel).alias("channel"), F.col(v).cast("int").alias("v"), F.col(u).cast("int").alias("u"), "weight")
            out = rows if out is None else out.unionByName(rows)
    return out


def _of(table: dict[int, int], strategy: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v).cast("long") for pair in table.items() for v in pair)), strategy)


def dequantised(coefs: DataFrame, blocks: DataFrame, weights: DataFrame, tiles: DataFrame, scale: float = 1.0) -> DataFrame:
    """(image_id, channel, block, v, u, coef) of quantised coefficients beside the lowest, with chroma's share of luma.

    A value is that of the biased quantised one, times scale / quantisation / weight. Channels 0 and 2 get fx and fb times channel 1's
    coefficient, by the tile in which the coefficient's place lies as if it were a sample; a tile that is missing gives none.
    """
    own = blocks.select("image_id", "block", "strategy", F.col("y").alias("by"), F.col("x").alias("bx"), "quantisation")
    rows = coefs.where("q <> 0").join(own, ["image_id", "block"])
    low = (F.col("v") < _of({k: h for k, (_, h) in CELLS.items()}, F.col("strategy"))) & (F.col("u") < _of({k: w for k, (w, _) in CELLS.items()}, F.col("strategy")))
    rows = rows.where(~low).join(F.broadcast(weights), ["strategy", "channel", "v", "u"])
    value = dequantise(F.col("q"), F.col("channel")) * (F.lit(scale) / F.col("quantisation") / F.col("weight"))
    rows = rows.select("image_id", "channel", "block", "v", "u", value.alias("coef"), F.floor((F.col("by") + F.floor(F.col("v") / 8)) / 8).alias("ty"), F.floor((F.col("bx") + F.floor(F.col("u") / 8)) / 8).alias("tx"))
    luma = rows.where("channel = 1").join(tiles, ["image_id", "ty", "tx"])
    share = F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("fx").alias("f")), F.struct(F.lit(2).alias("channel"), F.col("fb").alias("f"))))
    shared = luma.withColumn("s", share).select("image_id", "s.channel", "block", "v", "u", (F.col("s.f") * F.col("coef")).alias("coef"))
    both = rows.select(shared.columns).unionByName(shared)
    return both.groupBy("image_id", "channel", "block", "v", "u").agg(F.sum("coef").alias("coef"))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (image_id, channel, by, bx, strategy, values) to samples; a value is (kind, v, u, value), kind 0 for cells."""
    inverse = {k: np.linalg.inv(small_matrix(name)) for k, name in SMALL.items()}
    for batch in batches:
        strategies, lists = batch.column(4).to_numpy(), batch.column(5)
        counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        kind, v, u, value = (flat.field(k).to_numpy() for k in range(4))
        owner = np.repeat(np.arange(batch.num_rows), counts)
        for strategy in np.unique(strategies).tolist():
            if strategy not in CELLS or 14 <= strategy <= 17:
                raise ValueError(f"strategy {strategy} has no transform here")
            w, h = CELLS[strategy]
            rows = np.flatnonzero(strategies == strategy)
            number = np.full(batch.num_rows, -1)
            number[rows] = np.arange(len(rows))
            mine = number[owner] >= 0
            cells, coefs = np.zeros((len(rows), h, w)), np.zeros((len(rows), 8 * h, 8 * w))
            for target, which in ((cells, mine & (kind == 0)), (coefs, mine & (kind == 1))):
                target[number[owner[which]], v[which], u[which]] = value[which]
            coefs[:, :h, :w] = lows_of(h) @ cells @ lows_of(w).T
            if strategy in SMALL:
                made = (coefs.reshape(len(rows), 64) @ inverse[strategy].T).reshape(coefs.shape)
            else:
                made = samples_of(8 * h) @ coefs @ samples_of(8 * w).T
            at, of = np.indices(made.shape[1:]).reshape(2, -1), np.repeat(rows, 64 * h * w)
            y = batch.column(2).to_numpy()[of] * 8 + np.tile(at[0], len(rows))
            x = batch.column(3).to_numpy()[of] * 8 + np.tile(at[1], len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(y), pa.array(x), pa.array(made.reshape(-1))], ["image_id", "channel", "y", "x", "v"])


def reconstruct(coefs: DataFrame, blocks: DataFrame, cells: DataFrame, weights: DataFrame, tiles: DataFrame, scale: float = 1.0) -> DataFrame:
    """(image_id, channel, y, x, v) of all blocks.

    coefs (image_id, channel, block, v, u, q): quantised; those that cells stand for are not read, those missing are 0.
    blocks (image_id, block, strategy, y, x, quantisation), at cells y, x. cells (image_id, channel, y, x, v): a value for each
    cell of 8 x 8 samples, without which a block's lowest frequencies are 0. weights and tiles as ``dequantised`` has them.
    """
    ready(coefs.sparkSession)
    ac = dequantised(coefs, blocks, weights, tiles, scale).select("image_id", "channel", "block", F.struct(F.lit(1).alias("kind"), F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"), F.col("coef").alias("value")).alias("s"))
    across, down = (_of({k: c[i] for k, c in CELLS.items()}, F.col("strategy")) for i in (0, 1))
    places = blocks.select("image_id", "block", F.col("y").alias("by"), F.col("x").alias("bx"), across.alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), across * down - 1)).alias("k"))
    places = places.select("image_id", "block", F.floor(F.col("k") / F.col("w")).cast("int").alias("dy"), (F.col("k") % F.col("w")).cast("int").alias("dx"), "by", "bx")
    places = places.withColumn("y", F.col("by") + F.col("dy")).withColumn("x", F.col("bx") + F.col("dx"))
    low = places.join(cells, ["image_id", "y", "x"]).select("image_id", "channel", "block", F.struct(F.lit(0).alias("kind"), F.col("dy").alias("v"), F.col("dx").alias("u"), F.col("v").cast("double").alias("value")).alias("s"))
    per = ac.unionByName(low).groupBy("image_id", "block", "channel").agg(F.collect_list("s").alias("s"))
    per = per.join(blocks.select("image_id", "block", F.col("y").alias("by"), F.col("x").alias("bx"), "strategy"), ["image_id", "block"])
    out = per.select("image_id", F.col("channel").cast("int").alias("channel"), F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx"), F.col("strategy").cast("long").alias("strategy"), "s")
    return out.mapInArrow(_made, "image_id string, channel int, y long, x long, v double")
