"""Registered queries of counts, estimates and layouts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselune.functions import codes, contexts
from tesselune.operators import entropy, layout, neighbours, weighted
from tesselune.operators.weighted import Leaf
from tesselune.plans.adaptive import _CORRECTING
from tesselune.plans.queries import _FREQ, _GRADIENT, _QUANT, _RASTER, _RGB8, _TOKEN, _ZIGZAG, _hist, _near, _quantised, _query
from tesselune.sources import rasters


@_query(f"""{_QUANT}, m AS (SELECT q, count(*) AS n FROM q WHERE q <> 0 GROUP BY q), e AS (SELECT q, n, floor(log2(abs(q)))::INTEGER AS e FROM m),
    d AS (SELECT *, 256 + floor((abs(q) / pow(2, e) - 1) * 256)::BIGINT AS d FROM e)
    SELECT q, n, sign(q) * (1 + (((524288 // (2 * d + 1)) + 1) // 2 - 256) / 256.0::DOUBLE) * pow(2, -1 - e) AS estimate FROM d""")
def reciprocal_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantised(spark, sf_dir).where("q <> 0").groupBy("q").agg(F.count("*").alias("n"))
    return rows.select("q", "n", codes.reciprocal_estimate(F.col("q")).alias("estimate"))


@_query(f"""{_FREQ}, bits AS (SELECT token, freq, floor(log2(freq))::INTEGER AS top FROM freqs), told AS (SELECT *, greatest(0, least(top, 5 - ((12 - top) >> 1))) AS told FROM bits),
    kept AS (SELECT token, freq, CASE WHEN freq <= 1 THEN freq ELSE (freq >> (top - told)) << (top - told) END AS kept FROM told),
    o AS (SELECT *, row_number() OVER (ORDER BY floor(log2(kept)) DESC, token) = 1 AS omitted FROM kept)
    SELECT token, freq, CASE WHEN omitted THEN 4096 - (SELECT sum(kept) FROM o WHERE NOT omitted) ELSE kept END::BIGINT AS kept, omitted FROM o""")
def coarse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.coarse_counts(entropy.frequencies(_hist(spark, sf_dir)).select("token", "freq"), 5)


@_query(f"""{_FREQ} SELECT t AS token, coalesce(n, 0) AS n, coalesce(freq, 0)::BIGINT AS freq FROM range(0, 64) r(t) LEFT JOIN freqs ON token = t""")
def table_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of an alphabet of 64 tokens, some of which do not occur."""
    alphabet = spark.range(64).withColumnRenamed("id", "token").join(_hist(spark, sf_dir), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    return entropy.table_frequencies(alphabet)


@_query(f"""WITH {_RASTER} SELECT CASE x % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS channel, y, x // 3 AS x, v FROM raster WHERE x // 3 < (SELECT (max(x) + 1) // 3 FROM raster)""")
def planes_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's lines read as pixels of blue, green and red."""
    return layout.planes_by_role(rasters.embedding_raster(spark, sf_dir), "bgr", "rgb").select("channel", "y", "x", "v")


@_query(f"WITH {_RASTER} SELECT y, x, v FROM raster")
def checked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.checked(rasters.embedding_raster(spark, sf_dir), 8).select("y", "x", "v")


@_query(f"""{_QUANT} SELECT "by", bx, u AS v, v AS u, q + CASE WHEN v + u = 0 THEN 341 ELSE 0 END AS q FROM q""")
def bridged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bridged(_quantised(spark, sf_dir).select("by", "bx", "v", "u", "q"), 3)


@_query("""WITH f AS (SELECT *, length(coalesce(text, '')) % 3 = 0 AS fin FROM conversations)
    SELECT conv_id, count(*) AS parts, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AND count_if(fin) = 1 AND coalesce(max(turn) FILTER (fin) = max(turn), false) AS complete,
        md5(coalesce(string_agg(text, '' ORDER BY turn, text), '')) AS joined FROM f GROUP BY 1""")
def flagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which the final one, and no other, must bear a flag."""
    rows = rasters.table(spark, sf_dir, "conversations").withColumn("fin", F.length(F.coalesce("text", F.lit(""))) % 3 == 0)
    return layout.joined_parts(rows, "conv_id", "turn", "text", last="fin").withColumn("joined", F.md5("joined"))


@_query("""SELECT source, doc_id, n_chars AS size, doc_id * 7919 % 1000003 AS place,
    coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1000003 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM documents""")
def permuted_section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections stored in another order than their numbers': where each begins."""
    rows = rasters.table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("size"), (F.col("doc_id") * 7919 % 1000003).alias("place"))
    return layout.prefix_offsets(rows, ("source",), "place", "size", "at")


@_query(f"""{_CORRECTING}, e AS (SELECT prop AS p FROM s WHERE i >= 0)
    SELECT CASE WHEN p > 0 THEN 0 ELSE 1 END AS of_2, CASE WHEN p > 90 THEN 0 WHEN p > 0 THEN 1 WHEN p > -90 THEN 2 ELSE 3 END AS of_4, count(*) AS n FROM e GROUP BY ALL""")
def error_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by bins of the self-correcting predictor's error."""
    errors = weighted.tree_residuals(rasters.embedding_raster(spark, sf_dir), (15, 0, Leaf(6), Leaf(6)), 16)
    bins = [contexts.activity_bin(F.col("error"), t).cast("int").alias(n) for n, t in {"of_2": (0,), "of_4": (-90, 0, 90)}.items()]
    return errors.groupBy(*bins).agg(F.count("*").alias("n"))


@_query(f"""WITH {_RGB8}, planes AS (SELECT 0 AS channel, y, x, r AS v FROM rgb UNION ALL SELECT 1, y, x, g FROM rgb UNION ALL SELECT 2, y, x, b FROM rgb), {_near('planes', 'channel')},
    res AS (SELECT channel, {_ZIGZAG.format(r=f'(v - {_GRADIENT})')} AS u FROM near), t AS (SELECT channel, {_TOKEN} AS token FROM res)
    SELECT token, count(*) FILTER (channel = 0) AS n0, count(*) FILTER (channel = 1) AS n1, count(*) FILTER (channel = 2) AS n2, count(*) AS pooled FROM t GROUP BY token""")
def pooled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual tokens of three channels, each by itself and pooled."""
    planes = rasters.embedding_pixels(spark, sf_dir).select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("channel", "v"))
    tokens = neighbours.residual_tokens(planes)
    return tokens.groupBy("token").agg(*[F.count_if(F.col("channel") == k).alias(f"n{k}") for k in range(3)], F.count("*").alias("pooled"))


@_query("""WITH b AS (SELECT p_partkey, p_partkey % 3 AS channel, p_size % 13 AS bucket, p_size % 29 AS quant, p_partkey % 101 - 50 AS x, p_partkey % 57 AS y, p_partkey % 33 - 16 AS z FROM part),
    p AS (SELECT *, ((((CASE channel WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END * 13 + bucket) * 3 + (quant > 4)::INTEGER + (quant > 12)::INTEGER) * 2 + (x > 0)::INTEGER) * 3 + (y > 9)::INTEGER + (y > 30)::INTEGER) * 1 AS place FROM b)
    SELECT p_partkey, place::INTEGER AS place, (place * 7 % 16)::INTEGER AS cluster, (CASE channel WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END * 13 + bucket)::BIGINT % 5 AS context FROM p""")
def block_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of blocks by thresholds of their quantiser and cells, through a map, and contexts through a map of their own."""
    key, size = F.col("p_partkey"), F.col("p_size")
    place, n = contexts.block_cluster(key % 3, size % 13, size % 29, (key % 101 - 50, key % 57, key % 33 - 16), [4, 12], ([0], [9, 30], []))
    table = spark.createDataFrame([(k, k * 7 % 16) for k in range(n)], "place int, cluster int")
    context = contexts.block_context(key % 3, size % 13, tuple(k % 5 for k in range(39)))
    rows = rasters.table(spark, sf_dir, "part").select("p_partkey", place.cast("int").alias("place"), context.cast("bigint").alias("context"))
    return rows.join(F.broadcast(table), "place").select("p_partkey", "place", "cluster", "context")  # the map has n rows


_CHANNELS = """ch AS (SELECT p_partkey // 5 AS image_id, p_partkey % 5 AS channel, p_size * 40 AS width, 20 + p_partkey % 900 AS height, (p_size % 5)::INTEGER - 1 AS hshift, (p_partkey % 7 % 5)::INTEGER AS vshift, p_partkey % 5 = 0 AS meta FROM part),
    f AS (SELECT *, min(CASE WHEN NOT meta AND (width > 512 OR height > 512) THEN channel END) OVER (PARTITION BY image_id) AS first FROM ch),
    k AS (SELECT *, CASE WHEN first IS NULL OR channel < first THEN 'global' WHEN hshift >= 3 AND vshift >= 3 THEN 'dc' ELSE 'ac' END AS kind, greatest(0, hshift) AS hs, greatest(0, vshift) AS vs FROM f)"""


@_query(f"""WITH {_CHANNELS}, g AS (SELECT *, CASE kind WHEN 'dc' THEN 4096 ELSE 512 END AS d FROM k WHERE kind <> 'global'),
    s AS (SELECT image_id, channel, kind, gy, gx, (gy * d) >> vs AS y0, (gx * d) >> hs AS x0, least(height, ((gy + 1) * d) >> vs) AS y1, least(width, ((gx + 1) * d) >> hs) AS x1
          FROM g, LATERAL (SELECT unnest(range(0, (height << vs) // d + 1)) AS gy), LATERAL (SELECT unnest(range(0, (width << hs) // d + 1)) AS gx))
    SELECT image_id, channel, kind, gy, gx, y0, x0, y1 - y0 AS h, x1 - x0 AS w FROM s WHERE y0 < y1 AND x0 < x1""")
def shifted_group_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of several sizes and shifts, five an image, cut by groups of 512."""
    key, size = F.col("p_partkey"), F.col("p_size")
    channels = rasters.table(spark, sf_dir, "part").select(
        F.floor(key / 5).alias("image_id"), (key % 5).alias("channel"), (size * 40).cast("long").alias("width"), (20 + key % 900).alias("height"),
        ((size % 5).cast("int") - 1).alias("hshift"), (key % 7 % 5).cast("int").alias("vshift"), (key % 5 == 0).alias("meta"),
    )
    return layout.group_slices(channels, 512)
