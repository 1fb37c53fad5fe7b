"""Registered queries of the raster and codec operators over the tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselune.functions import codes, contexts
from tesselune.operators import blocks, entropy, layout, neighbours, recurrences, smallblocks, stencils, tiles, weighted
from tesselune.operators.transforms import coefficients
from tesselune.sources import rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A tree over four properties, for the queries: change w - nw, gradient, line, size of n.
TREE = (10, 0, (9, 120, 0, (2, 100, 1, 2)), (8, -5, (4, 110, 3, 4), 5))
TREE_SQL = """CASE WHEN w - nw > 0 THEN CASE WHEN w + n - nw > 120 THEN 0 WHEN y > 100 THEN 1 ELSE 2 END
              WHEN w - n > -5 THEN CASE WHEN abs(n) > 110 THEN 3 ELSE 4 END ELSE 5 END"""
BANDS = [3150.0, 0.67, 0.5, 0.67, 0.5, 0.33]

# ---- common SQL ---------------------------------------------------------------------------------

_RASTER = """raster AS (
    SELECT vec_id AS y, i - 1 AS x, floor((embedding[i]::DOUBLE + 1.0) * 127.5)::BIGINT AS v
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def _near(source: str = "raster", keys: str = "") -> str:
    """CTEs up to ``near``: samples with neighbours, by further partition keys."""
    also = f"{keys}, " if keys else ""
    return f"""up AS (SELECT *, lag(v) OVER (PARTITION BY {also}x ORDER BY y) AS n0, lag(v, 2) OVER (PARTITION BY {also}x ORDER BY y) AS nn0 FROM {source}),
    side AS (SELECT *, lag(v) OVER l AS w0, lag(v, 2) OVER l AS ww0, lag(n0) OVER l AS nw0, lead(n0) OVER l AS ne0, lag(x) OVER l AS x0 FROM up WINDOW l AS (PARTITION BY {also}y ORDER BY x)),
    near1 AS (SELECT *, coalesce(w0, n0, 0) AS w FROM side),
    near2 AS (SELECT *, coalesce(n0, w) AS n FROM near1),
    near AS (SELECT *, coalesce(nw0, CASE WHEN x0 IS NOT NULL THEN w ELSE n END) AS nw, coalesce(ne0, n) AS ne, coalesce(ww0, w) AS ww, coalesce(nn0, n) AS nn FROM near2)"""


_GRADIENT = "greatest(least(w, n), least(greatest(w, n), w + n - nw))"
_ZIGZAG = "CASE WHEN {r} >= 0 THEN 2 * {r} ELSE -2 * {r} - 1 END"
_BITS = "CASE WHEN {u} = 0 THEN 0 ELSE floor(log2({u}))::BIGINT + 1 END"
_TOKEN = "CASE WHEN u < 16 THEN u ELSE 16 + floor(log2(u))::BIGINT - 4 END"
_RESIDUALS = f"WITH {_RASTER}, {_near()}, res AS (SELECT y, x, {_ZIGZAG.format(r=f'(v - {_GRADIENT})')} AS u FROM near), tok AS (SELECT y, x, u, {_TOKEN} AS token FROM res)"
_HIST = f"{_RESIDUALS}, hist AS (SELECT token, count(*) AS n FROM tok GROUP BY token)"
_FREQ = _HIST.replace("WITH ", "WITH RECURSIVE ", 1) + """,
    f0 AS (SELECT token, n, greatest(1, n * 4096 // (sum(n) OVER ())::BIGINT)::BIGINT AS freq FROM hist),
    st(step, arr) AS (
        SELECT 0, (SELECT list(freq ORDER BY token) FROM f0)
        UNION ALL
        SELECT step + 1, list_transform(range(1, len(arr) + 1), lambda k: CASE WHEN k = list_position(arr, list_max(arr)) THEN arr[k] + sign(4096 - list_sum(arr))::BIGINT ELSE arr[k] END)
        FROM st WHERE list_sum(arr) <> 4096),
    done AS (SELECT arr FROM st ORDER BY step DESC LIMIT 1),
    freqs AS (SELECT token, n, (SELECT arr FROM done)[row_number() OVER (ORDER BY token)] AS freq FROM f0),
    cums AS (SELECT token, n, freq, coalesce(sum(freq) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM freqs)"""
_LENGTHS = f"""{_HIST},
    ranked AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS r, count(*) OVER () AS c FROM hist),
    lens AS (SELECT token, n, (CASE WHEN c = 1 THEN 0 WHEN c = 2 THEN 1 WHEN r <= pow(2, ceil(log2(c))) - c THEN ceil(log2(c)) - 1 ELSE ceil(log2(c)) END)::INTEGER AS len FROM ranked)"""
_PIXELS = "px AS (SELECT l_quantity::BIGINT AS a, round(l_discount * 100)::BIGINT AS b, round(l_tax * 100)::BIGINT AS c, count(*) AS n FROM lineitem GROUP BY ALL)"


def _query(sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---- neighbours and predictors ------------------------------------------------------------------


@_query(f"{_RESIDUALS} SELECT token, count(*) AS n FROM tok GROUP BY token")
def gradient_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.histogram(neighbours.residual_tokens(rasters.embedding_raster(spark, sf_dir)))


@_query(f"WITH {_RASTER}, {_near()} SELECT y, x, v, w, n, nw, ne, ww, nn FROM near")
def neighbour_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(rasters.embedding_raster(spark, sf_dir)).select("y", "x", "v", "w", "n", "nw", "ne", "ww", "nn")


@_query(f"WITH {_RASTER}, tiles AS (SELECT *, y // 16 AS gy, x // 16 AS gx FROM raster), {_near('tiles', 'gy, gx')} SELECT gy, gx, y, x, w, n, nw, ne, ww, nn FROM near")
def tiled_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = neighbours.tiled(rasters.embedding_raster(spark, sf_dir), 16)
    return neighbours.neighbours(tiles, ("image_id", "channel", "gy", "gx")).select("gy", "gx", "y", "x", "w", "n", "nw", "ne", "ww", "nn")


_PREDICTORS = {
    0: "0", 1: "w", 2: "n", 3: "(w + n) >> 1", 4: "CASE WHEN abs(w - nw) < abs(n - nw) THEN n ELSE w END", 5: _GRADIENT, 7: "ne", 8: "nw", 9: "ww",
    10: "(w + nw) >> 1", 11: "(nw + n) >> 1", 12: "(n + ne) >> 1", 13: "(w + n + ne + nw) >> 2",
}


def _predictor_query(kind: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = neighbours.neighbours(rasters.embedding_raster(spark, sf_dir)).withColumn("r", F.col("v") - neighbours.predictor(kind))
        return out.groupBy("y").agg(F.sum("r").alias("residuals"), F.sum(F.abs("r")).alias("magnitude"), F.sum(F.col("r") * (F.col("x") + 1)).alias("checksum"))

    run.__name__ = f"predictor_{kind}"
    _query(f"WITH {_RASTER}, {_near()}, r AS (SELECT y, x, v - ({_PREDICTORS[kind]}) AS r FROM near) SELECT y, sum(r)::BIGINT AS residuals, sum(abs(r))::BIGINT AS magnitude, sum(r * (x + 1))::BIGINT AS checksum FROM r GROUP BY y")(run)


for _kind in _PREDICTORS:
    _predictor_query(_kind)


@_query(f"WITH {_RASTER}, {_near()}, r AS (SELECT v - n AS r FROM near), z AS (SELECT r, {_ZIGZAG.format(r='r')} AS u FROM r) SELECT r, u, r AS back, count(*) AS n FROM z GROUP BY ALL")
def zigzag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.neighbours(rasters.embedding_raster(spark, sf_dir)).select((F.col("v") - F.col("n")).alias("r"))
    out = out.withColumn("u", codes.zigzag(F.col("r"))).withColumn("back", codes.unzigzag(F.col("u")))
    return out.groupBy("r", "u", "back").agg(F.count("*").alias("n"))


@_query(f"WITH {_RASTER}, {_near()} SELECT y, x, 0::BIGINT AS p0, 0::BIGINT AS p1, y AS p2, x AS p3, abs(n) AS p4, abs(w) AS p5, n AS p6, w AS p7, w - n AS p8, w + n - nw AS p9, w - nw AS p10, nw - n AS p11, n - ne AS p12, n - nn AS p13, w - ww AS p14 FROM near")
def tree_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.neighbours(rasters.embedding_raster(spark, sf_dir))
    return out.select("y", "x", *[c.alias(f"p{k}") for k, c in neighbours.properties(out).items()])


@_query(f"WITH {_RASTER}, {_near()} SELECT {TREE_SQL} AS leaf, count(*) AS n, sum(v)::BIGINT AS total FROM near GROUP BY 1")
def tree_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.neighbours(rasters.embedding_raster(spark, sf_dir))
    leaf = neighbours.tree_leaf(TREE, neighbours.properties(out))
    return out.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@_query(f"WITH {_RASTER}, {_near()} SELECT y, x, v - CASE WHEN y = 0 AND x = 0 THEN 0 WHEN y = 0 THEN w WHEN x = 0 THEN n ELSE {_GRADIENT} END AS residual FROM near")
def plane_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.plane_residuals(rasters.embedding_raster(spark, sf_dir)).select("y", "x", "residual")


def _lossless_jpeg(kind: int, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = neighbours.lossless_jpeg_residuals(rasters.embedding_raster(spark, sf_dir), kind)
        return out.groupBy("y").agg(F.sum("residual").alias("residuals"), F.sum(F.col("residual") * (F.col("x") + 1)).alias("checksum"))

    run.__name__ = f"lossless_jpeg_{kind}"
    guess = f"CASE WHEN x = 0 AND y = 0 THEN 128 WHEN y = 0 THEN w WHEN x = 0 THEN n ELSE {sql} END"
    _query(f"WITH {_RASTER}, {_near()}, r AS (SELECT y, x, ((v - ({guess})) % 65536 + 65536) % 65536 AS r FROM near) SELECT y, sum(r)::BIGINT AS residuals, sum(r * (x + 1))::BIGINT AS checksum FROM r GROUP BY y")(run)


for _kind, _sql in {1: "w", 2: "n", 3: "nw", 4: "w + n - nw", 5: "w + ((n - nw) >> 1)", 6: "n + ((w - nw) >> 1)", 7: "(w + n) >> 1"}.items():
    _lossless_jpeg(_kind, _sql)


# ---- codes and colour ---------------------------------------------------------------------------


@_query("""WITH u AS (SELECT doc_id, n_chars AS u FROM documents), e AS (SELECT *, floor(log2(greatest(u, 1)))::BIGINT AS n FROM u)
    SELECT doc_id, u, CASE WHEN u < 16 THEN u ELSE 16 + (n - 4) * 4 + ((u >> (n - 2)) & 3) END AS token,
           CASE WHEN u < 16 THEN 0 ELSE u & ((1::BIGINT << (n - 2)) - 1) END AS extra, CASE WHEN u < 16 THEN 0 ELSE n - 2 END::INTEGER AS n_extra, u AS back FROM e""")
def hybrid_uint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rasters.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("u"))
    token, extra, count = codes.hybrid_uint(F.col("u"))
    out = out.select("doc_id", "u", token.alias("token"), extra.alias("extra"), count.alias("n_extra"))
    return out.withColumn("back", codes.unhybrid_uint(F.col("token"), F.col("extra")).cast("long"))


@_query(f"WITH {_PIXELS} SELECT a, b, c, n, (c + ((a - c) >> 1)) + ((b - (c + ((a - c) >> 1))) >> 1) AS luma, a - c AS co, b - (c + ((a - c) >> 1)) AS cg, a AS r, b AS g, c AS bl FROM px")
def rct_forward_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (F.col(k) for k in "abc")
    y, co, cg = codes.ycocg_forward(a, b, c)
    out = rasters.lineitem_pixels(spark, sf_dir).select("a", "b", "c", "n", y.alias("luma"), co.alias("co"), cg.alias("cg"))
    r, g, bl = codes.ycocg_inverse(F.col("luma"), F.col("co"), F.col("cg"))
    return out.select("*", r.alias("r"), g.alias("g"), bl.alias("bl"))


def _rct_sql() -> str:
    kinds = []
    for kind in range(42):
        order, mode = divmod(kind, 7)
        if mode == 6:
            d, e, f = "((a - (c >> 1)) - (b >> 1)) + b", "c + (a - (c >> 1))", "(a - (c >> 1)) - (b >> 1)"
        else:
            d, f = "a", "(c + a)" if mode % 2 else "c"
            e = {0: "b", 1: "(b + a)", 2: f"(b + ((a + {f}) >> 1))"}[mode // 2]
        out = [""] * 3
        out[order % 3], out[(order + 1 + order // 3) % 3], out[(order + 2 - order // 3) % 3] = d, e, f
        kinds.append(f"SELECT {kind} AS kind, sum(({out[0]}) * n)::BIGINT AS s0, sum(({out[1]}) * n)::BIGINT AS s1, sum(({out[2]}) * n)::BIGINT AS s2, sum((({out[0]}) + 3 * ({out[1]}) + 7 * ({out[2]})) * (a + 1) * n)::BIGINT AS checksum FROM px")
    return f"WITH {_PIXELS} " + " UNION ALL ".join(kinds)


@_query(_rct_sql())
def rct_inverse_all42(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (F.col(k) for k in "abc")
    sums = []
    for kind in range(42):
        x, y, z = codes.rct_inverse(kind, a, b, c)
        n = F.col("n")
        sums.append(F.struct(F.lit(kind).alias("kind"), F.sum(x * n).alias("s0"), F.sum(y * n).alias("s1"), F.sum(z * n).alias("s2"), F.sum((x + 3 * y + 7 * z) * (a + 1) * n).alias("checksum")))
    one = rasters.lineitem_pixels(spark, sf_dir).agg(F.array(*sums).alias("k"))
    return one.select(F.explode("k").alias("k")).select("k.*")


_RGB8 = "rgb AS (SELECT vec_id AS y, x, " + ", ".join(f"floor((embedding[3 * x + {k + 1}]::DOUBLE + 1.0) * 127.5)::BIGINT AS {c}" for k, c in enumerate("rgb")) + """
    FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 3)) AS x FROM embeddings)), size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM rgb)"""


def _rgb_planes() -> str:
    parts = ["r", "g", "b", "(b + ((r - b) >> 1)) + ((g - (b + ((r - b) >> 1))) >> 1)", "r - b", "g - (b + ((r - b) >> 1))"]
    return f"WITH {_RGB8}, planes AS (" + " UNION ALL ".join(f"SELECT {k} AS channel, y, x, {p} AS v FROM rgb" for k, p in enumerate(parts)) + f"), {_near('planes', 'channel')}"


@_query(f"{_rgb_planes()}, u AS (SELECT channel, {_ZIGZAG.format(r=f'(v - {_GRADIENT})')} AS u FROM near) SELECT CASE WHEN channel < 3 THEN 'rgb' ELSE 'ycocg' END AS space, sum({_BITS.format(u='u')})::BIGINT AS bits FROM u GROUP BY 1")
def rct_gate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = rasters.embedding_pixels(spark, sf_dir)
    r, g, b = (F.col(k) for k in "rgb")
    planes = pixels.select("image_id", "y", "x", F.posexplode(F.array(r, g, b, *codes.ycocg_forward(r, g, b))).alias("channel", "v"))
    out = neighbours.neighbours(planes)
    u = codes.zigzag(F.col("v") - neighbours.gradient(F.col("w"), F.col("n"), F.col("nw")))
    space = F.when(F.col("channel") < 3, "rgb").otherwise("ycocg")
    return out.groupBy(space.alias("space")).agg(entropy.bit_length_cost(u).cast("long").alias("bits"))


@_query("""WITH pal AS (SELECT n_nationkey AS i, (n_nationkey * 37 % 256)::BIGINT AS r, (n_nationkey * 91 % 256)::BIGINT AS g, (n_nationkey * 53 % 256)::BIGINT AS b FROM nation),
    px AS (SELECT c_custkey AS k, c_custkey % 100 AS i FROM customer)
    SELECT k, px.i AS i, CASE WHEN px.i < s THEN r WHEN px.i < s + 64 THEN ((((px.i - s) & 3) * 255) >> 2) + 32 ELSE 0 END AS r,
           CASE WHEN px.i < s THEN g WHEN px.i < s + 64 THEN ((((px.i - s) >> 2 & 3) * 255) >> 2) + 32 ELSE 0 END AS g,
           CASE WHEN px.i < s THEN b WHEN px.i < s + 64 THEN ((((px.i - s) >> 4 & 3) * 255) >> 2) + 32 ELSE 0 END AS b
    FROM px CROSS JOIN (SELECT count(*) AS s FROM nation) LEFT JOIN pal ON px.i = pal.i""")
def palette_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = rasters.table(spark, sf_dir, "nation")
    pal = nation.select(F.col("n_nationkey").cast("long").alias("i"), *[(F.col("n_nationkey") * m % 256).cast("long").alias(f"p{k}") for k, m in enumerate((37, 91, 53))])
    px = rasters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 100).alias("i"))
    size = F.lit(nation.count())
    cube = [F.shiftright(F.shiftright(F.col("i") - size, 2 * c).bitwiseAND(3) * 255, 2) + 32 for c in range(3)]
    out = px.join(pal, "i", "left")
    return out.select("k", "i", *[F.when(F.col("i") < size, F.col(f"p{c}")).when(F.col("i") < size + 64, cube[c]).otherwise(0).cast("long").alias("rgb"[c]) for c in range(3)])


_XYB = """lms AS (SELECT *, cbrt(0.30 * r + 0.622 * g + 0.078 * b + 0.0037930732552754493) - cbrt(0.0037930732552754493) AS l,
        cbrt(0.23 * r + 0.692 * g + 0.078 * b + 0.0037930732552754493) - cbrt(0.0037930732552754493) AS m,
        cbrt(0.24342268924547819 * r + 0.20476744424496821 * g + 0.5518098665095536 * b + 0.0037930732552754493) - cbrt(0.0037930732552754493) AS s FROM lin)"""
_LINEAR = "CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END"


@_query(f"""WITH {_PIXELS}, u AS (SELECT a, b, c, a / 50.0::DOUBLE AS x, b / 100.0::DOUBLE AS y, c / 100.0::DOUBLE AS z FROM px),
    lin AS (SELECT a AS qa, b AS qb, c AS qc, {_LINEAR.format(v='x')} AS r, {_LINEAR.format(v='y')} AS g, {_LINEAR.format(v='z')} AS b FROM u), {_XYB}
    SELECT qa, qb, qc, round((l - m) * 0.5, 8) + 0.0 AS xyb_x, round((l + m) * 0.5, 8) + 0.0 AS xyb_y, round(s, 8) + 0.0 AS xyb_b FROM lms""")
def srgb_to_xyb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = [codes.srgb_to_linear(F.col(k) / d) for k, d in (("a", 50.0), ("b", 100.0), ("c", 100.0))]
    x, y, b = codes.linear_to_xyb(*rgb)
    out = rasters.lineitem_pixels(spark, sf_dir)
    return out.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("c").alias("qc"), *[(F.round(v, 8) + 0.0).alias(n) for v, n in ((x, "xyb_x"), (y, "xyb_y"), (b, "xyb_b"))])


@_query(f"""WITH {_RASTER}, v AS (SELECT v AS code, v / 255.0::DOUBLE AS v, count(*) AS n FROM raster GROUP BY ALL), l AS (SELECT code, n, {_LINEAR.format(v='v')} AS lin FROM v)
    SELECT code, n, round(lin, 9) AS linear, round(255 * CASE WHEN lin <= 0.0031308 THEN lin * 12.92 ELSE 1.055 * pow(lin, 1 / 2.4::DOUBLE) - 0.055 END)::BIGINT AS back FROM l""")
def srgb_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = rasters.embedding_raster(spark, sf_dir).groupBy(F.col("v").alias("code")).agg(F.count("*").alias("n"))
    rows = levels.withColumn("lin", codes.srgb_to_linear(F.col("code") / 255.0))
    return rows.select("code", "n", F.round("lin", 9).alias("linear"), F.round(255 * codes.linear_to_srgb(F.col("lin"))).cast("long").alias("back"))


@_query(f"""WITH {_PIXELS}, s AS (SELECT a AS y, b + 90 AS cb, c + 120 AS cr, n FROM px)
    SELECT y, cb, cr, greatest(0, least(255, round(y + 1.402::DOUBLE * (cr - 128))))::BIGINT AS r, greatest(0, least(255, round(y - 0.344136::DOUBLE * (cb - 128) - 0.714136::DOUBLE * (cr - 128))))::BIGINT AS g,
           greatest(0, least(255, round(y + 1.772::DOUBLE * (cb - 128))))::BIGINT AS b FROM s""")
def ycbcr_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rasters.lineitem_pixels(spark, sf_dir).select(F.col("a").alias("y"), (F.col("b") + 90).alias("cb"), (F.col("c") + 120).alias("cr"))
    r, g, b = codes.ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))
    return out.select("y", "cb", "cr", r.alias("r"), g.alias("g"), b.alias("b"))


@_query(f"""WITH {_RASTER}, {_near()}, t AS (SELECT y, x, w AS b, v AS a, ne AS n FROM near),
    d AS (SELECT y, x, b, a, n, trunc((4 * b - 3 * n - a + 6) / 12.0)::BIGINT AS f0, trunc((4 * b - 3 * n - a - 6) / 12.0)::BIGINT AS r0 FROM t),
    d1 AS (SELECT *, CASE WHEN f0 - abs(f0 % 2) > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE f0 END AS f1, CASE WHEN r0 + abs(r0 % 2) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE r0 END AS r1 FROM d),
    d2 AS (SELECT *, CASE WHEN f1 + abs(f1 % 2) > 2 * (a - n) THEN 2 * (a - n) ELSE f1 END AS f2, CASE WHEN r1 - abs(r1 % 2) < 2 * (a - n) THEN 2 * (a - n) ELSE r1 END AS r2 FROM d1)
    SELECT y, x, CASE WHEN b >= a AND a >= n THEN f2 WHEN b <= a AND a <= n THEN r2 ELSE 0 END AS tendency FROM d2""")
def smooth_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.neighbours(rasters.embedding_raster(spark, sf_dir))
    return out.select("y", "x", codes.smooth_tendency(F.col("w"), F.col("v"), F.col("ne")).cast("long").alias("tendency"))


_CLASS = "CASE WHEN {b} BETWEEN 65 AND 90 OR {b} BETWEEN 97 AND 122 THEN 0 WHEN {b} BETWEEN 48 AND 57 OR {b} IN (46, 44) THEN 1"


@_query(f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS pos FROM t),
    bb AS (SELECT doc_id, pos, ('0x' || substr(h, 2 * pos + 1, 2))::INTEGER AS b FROM p),
    pr AS (SELECT doc_id, pos, coalesce(lag(b) OVER w, 0) AS b1, coalesce(lag(b, 2) OVER w, 0) AS b2 FROM bb WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    k AS (SELECT CASE WHEN pos <= 128 THEN 0 ELSE 1 + {_CLASS.format(b='b1')} WHEN b1 <= 1 THEN 2 + b1 WHEN b1 < 16 THEN 4 WHEN b1 > 240 AND b1 < 255 THEN 5 WHEN b1 = 255 THEN 6 ELSE 7 END
          + 8 * ({_CLASS.format(b='b2')} WHEN b2 < 16 THEN 2 WHEN b2 > 240 THEN 3 ELSE 4 END) END AS context FROM pr)
    SELECT context, count(*) AS n FROM k GROUP BY context""")
def icc_byte_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of the texts, by the two bytes before it: pairs are counted first, and contexts made of the few that differ."""
    rows = rasters.table(spark, sf_dir, "documents").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t")).where("length(t) > 0")
    at = rows.select("t", F.explode(F.expr("sequence(0, length(t) - 1)")).alias("pos"))
    pairs = at.groupBy(F.expr("IF(pos > 128, substring(t, pos - 1, 2), NULL)").alias("pair")).agg(F.count("*").alias("n"))
    b2, b1 = (F.conv(F.hex(F.substring("pair", k, 1)), 16, 10).cast("int") for k in (1, 2))
    context = F.when(F.col("pair").isNull(), 0).otherwise(codes.icc_context(F.lit(129), b1, b2))
    return pairs.groupBy(context.cast("int").alias("context")).agg(F.sum("n").alias("n"))


# ---- histograms and codes -----------------------------------------------------------------------


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gradient_token_histogram(spark, sf_dir)


@_query(f"{_FREQ} SELECT token, n, freq FROM freqs")
def frequency_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.frequencies(_hist(spark, sf_dir))


@_query(f"{_FREQ} SELECT token, n, freq, cum FROM cums")
def cumulative_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.cumulative(entropy.frequencies(_hist(spark, sf_dir)))


@_query(f"{_FREQ} SELECT s.i AS slot, token FROM range(4096) s(i) JOIN cums ON s.i >= cum AND s.i < cum + freq")
def slot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.slots(entropy.cumulative(entropy.frequencies(_hist(spark, sf_dir))))


@_query(f"{_FREQ} SELECT count(*) AS tokens, bool_and(same) AS is_flat FROM (SELECT freq = 4096 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY token) <= 4096 % count(*) OVER () THEN 1 ELSE 0 END AS same FROM freqs)")
def flat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.flat(entropy.frequencies(_hist(spark, sf_dir)))


@_query(f"{_LENGTHS} SELECT token, n, len FROM lens")
def prefix_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.code_lengths(_hist(spark, sf_dir))


@_query(f"{_LENGTHS} SELECT token, n, len, floor(coalesce(sum(pow(2, 15 - len)) OVER (ORDER BY len, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / pow(2, 15 - len))::BIGINT AS code FROM lens")
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.canonical_codes(entropy.code_lengths(_hist(spark, sf_dir)))


@_query(f"{_LENGTHS} SELECT count(*) AS tokens, sum(pow(2, 15 - len))::BIGINT AS kraft FROM lens")
def kraft_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.kraft(entropy.code_lengths(_hist(spark, sf_dir)))


@_query(f"{_LENGTHS} SELECT sum(n * len)::BIGINT AS bits FROM lens")
def codebook_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.code_cost(entropy.code_lengths(_hist(spark, sf_dir)))


@_query(f"{_HIST} SELECT round(sum(n) * log2(sum(n)) - sum(n * log2(n)), 6) AS bits FROM hist")
def histogram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.entropy_bits(_hist(spark, sf_dir)).select(F.round("bits", 6).alias("bits"))


@_query(f"""WITH {_RASTER}, r AS (SELECT x, v, row_number() OVER (PARTITION BY x ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY x) AS c FROM raster)
    SELECT x, k::INTEGER AS k, v AS threshold FROM r, range(1, 8) t(k) WHERE i = floor(c * k / 8)""")
def octile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.octiles(rasters.embedding_raster(spark, sf_dir), "x", "v")


@_query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n FROM events), n AS (SELECT max(n) AS n FROM p),
    want AS (SELECT DISTINCT i * n // 700 AS place FROM range(700) t(i), n)
    SELECT event_id FROM p WHERE n <= 700 OR place IN (SELECT place FROM want)""")
def uniform_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.uniform_subsample(rasters.table(spark, sf_dir, "events").select("event_id"), "event_id", 700)


# ---- layout, sections and timelines -------------------------------------------------------------


@_query(f"WITH {_RASTER} SELECT x - 8 AS x, y - 100 AS y, v FROM raster WHERE x BETWEEN 8 AND 39 AND y BETWEEN 100 AND 199")
def rectangle_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.crop(rasters.embedding_raster(spark, sf_dir), 8, 100, 32, 100).select("x", "y", "v")


@_query(f"WITH {_RASTER} SELECT y // 64 AS gy, x // 64 AS gx, count(*) AS samples, sum(v)::BIGINT AS total FROM raster GROUP BY ALL")
def tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.tiled(rasters.embedding_raster(spark, sf_dir), 64).groupBy("gy", "gx").agg(F.count("*").alias("samples"), F.sum("v").alias("total"))


@_query(f"""WITH {_RASTER}, size AS (SELECT max(y) AS h, max(x) AS w FROM raster)
    SELECT o::INTEGER AS orientation, CASE WHEN o IN (2, 3) THEN w - x WHEN o IN (5, 8) THEN y WHEN o IN (6, 7) THEN h - y ELSE x END AS x,
           CASE WHEN o IN (3, 4) THEN h - y WHEN o IN (5, 6) THEN x WHEN o IN (7, 8) THEN w - x ELSE y END AS y, v FROM raster, size, range(1, 9) o(o)""")
def exif_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = rasters.embedding_raster(spark, sf_dir)
    size = raster.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))  # a row an image
    rows = raster.join(size, "image_id").withColumn("orientation", F.explode(F.sequence(F.lit(1), F.lit(8))))
    x, y = layout.oriented(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("orientation"))
    return rows.select("orientation", x.alias("x"), y.alias("y"), "v")


@_query(f"WITH {_RASTER} SELECT count(*) AS samples, min(v) AS low, max(v) AS high, count_if(v < 0 OR v >= 128)::BIGINT AS bad FROM raster")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.out_of_range(rasters.embedding_raster(spark, sf_dir), 7).select("samples", "low", "high", "bad")


@_query("SELECT l_returnflag, min(l_quantity) = max(l_quantity) AS constant, min(l_quantity) AS low FROM lineitem GROUP BY 1")
def constant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return rows.select("l_returnflag", (F.col("low") == F.col("high")).alias("constant"), "low")


@_query("SELECT source, doc_id, n_chars AS size, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM documents")
def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return layout.prefix_offsets(rows, ("source",), "doc_id", "size", "at")


@_query("SELECT p_partkey, CASE WHEN p_size = 1 AND p_partkey % 3 + 1 = 1 THEN 1 ELSE 2 + (p_size + 7) // 8 + (p_partkey % 3 + 1) * p_size END::BIGINT AS sections FROM part")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, passes = F.col("p_size").cast("long"), F.col("p_partkey") % 3 + 1
    return rasters.table(spark, sf_dir, "part").select("p_partkey", layout.section_count(groups, F.floor((groups + 7) / 8), passes).cast("long").alias("sections"))


@_query("""SELECT user_id AS sequence_id, event_id AS i, event_id % 7 + 1 AS duration,
    coalesce(sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_tick FROM events""")
def frame_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.prefix_offsets(rasters.event_frames(spark, sf_dir), ("sequence_id",), "i", "duration", "start_tick")


@_query("SELECT user_id AS sequence_id, count(*) AS frames, sum(event_id % 7 + 1)::BIGINT AS ticks FROM events GROUP BY 1")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.event_frames(spark, sf_dir).groupBy("sequence_id").agg(F.count("*").alias("frames"), F.sum("duration").alias("ticks"))


@_query("""SELECT conv_id, count(*) AS parts, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete, md5(coalesce(string_agg(text, '' ORDER BY turn, text), '')) AS joined
    FROM conversations GROUP BY 1""")
def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_parts(rasters.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumn("joined", F.md5("joined"))


@_query("""SELECT l_orderkey, count(*) AS parts, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS complete, md5(string_agg(l_partkey::VARCHAR, '' ORDER BY l_linenumber, l_partkey::VARCHAR)) AS joined
    FROM lineitem GROUP BY 1""")
def profile_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("p"))
    return layout.joined_parts(rows, "l_orderkey", "l_linenumber", "p", 1).withColumn("joined", F.md5("joined"))


@_query("SELECT event_type AS marker, count(*) AS n, sum(length(props))::BIGINT AS bytes, '{\"version\":1,\"marker\":\"' || event_type || '\",\"count\":' || count(*) || '}' AS report FROM events GROUP BY 1")
def ancillary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("marker")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes"))
    return rows.withColumn("report", F.to_json(F.struct(F.lit(1).alias("version"), "marker", F.col("n").alias("count"))))


# ---- blocks and stencils ------------------------------------------------------------------------


def _order_sql(width: int, height: int) -> str:
    w, n, scale = width * 8, width * height * 64, width // height
    return f"""WITH c AS (SELECT i, i % {w} AS x, i // {w} AS y FROM range({n}) t(i)), d AS (SELECT *, x < {width} AND y < {height} AS low, x + y * {scale} AS d FROM c)
        SELECT row_number() OVER (ORDER BY CASE WHEN low THEN -1 ELSE d END, CASE WHEN low THEN i WHEN d % 2 = 1 THEN y ELSE -y END) - 1 AS place, i AS index FROM d"""


_DCT = f"""WITH {_RASTER}, b AS (SELECT k::INTEGER AS k, i::INTEGER AS i, CASE WHEN k = 0 THEN 1.0 ELSE sqrt(2.0) END / 8 * cos((2 * i + 1) * k * pi() / 16) AS b FROM range(8) k(k), range(8) i(i)),
    full_ AS (SELECT *, y // 8 AS "by", x // 8 AS bx, count(*) OVER (PARTITION BY y // 8, x // 8) AS n FROM raster),
    a AS (SELECT "by", bx, y % 8 AS iy, k AS u, sum(v * b) AS s FROM full_ JOIN b ON x % 8 = b.i WHERE n = 64 GROUP BY ALL),
    co AS (SELECT "by", bx, b.k AS v, u, sum(s * b) AS coef FROM a JOIN b ON iy = b.i GROUP BY ALL)"""


@_query(f"""{_DCT} SELECT "by", bx, v, u, round(coef, 6) + 0.0 AS coef FROM co""")
def dct8_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_coefficients(rasters.embedding_raster(spark, sf_dir)).select("by", "bx", "v", "u", (F.round("coef", 6) + 0.0).alias("coef"))


@_query(f"WITH {_RASTER}, f AS (SELECT *, count(*) OVER (PARTITION BY y // 8, x // 8) AS n FROM raster) SELECT y, x, v FROM f WHERE n = 64")
def dct8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = blocks.inverse_blocks(blocks.block_coefficients(rasters.embedding_raster(spark, sf_dir)))
    return back.select("y", "x", F.round("v").cast("long").alias("v"))


def _cosine_sql(n: int, k: str, i: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN 1.0::DOUBLE ELSE sqrt(2.0) END / {n} * cos((2 * ({i}) + 1) * ({k}) * pi() / {2 * n}))"


#: The weight of the sample in line y, column x in the coefficient in line a, column b, in closed form.
_SMALL = {
    "hornuss": """WHEN a < 2 AND b < 2 THEN pow(-1, a * (x // 4) + b * (y // 4)) / 64
        WHEN y // 4 = a % 2 AND x // 4 = b % 2 THEN (y % 4 = CASE WHEN a // 2 = 1 AND b // 2 = 1 THEN 0 ELSE a // 2 END AND x % 4 = CASE WHEN a // 2 = 1 AND b // 2 = 1 THEN 0 ELSE b // 2 END)::INTEGER - (y % 4 = 1 AND x % 4 = 1)::INTEGER""",
    "dct2x2": """WHEN a + b = 0 THEN 1 / 64.0::DOUBLE WHEN y // (8 // g) = a % g AND x // (8 // g) = b % g
        THEN pow(-1, (a // g) * (x // (4 // g) % 2) + (b // g) * (y // (4 // g) % 2)) * g * g / 64.0::DOUBLE""",
    "dct4x4": f"WHEN a < 2 AND b < 2 THEN pow(-1, a * (x // 4) + b * (y // 4)) / 64 WHEN y // 4 = a % 2 AND x // 4 = b % 2 THEN {_cosine_sql(4, 'b // 2', 'y % 4')} * {_cosine_sql(4, 'a // 2', 'x % 4')}",
    "dct4x8": f"WHEN b = 0 AND a < 2 THEN pow(-1, a * (y // 4)) / 64 WHEN y // 4 = a % 2 THEN {_cosine_sql(4, 'a // 2', 'y % 4')} * {_cosine_sql(8, 'b', 'x')}",
    "dct8x4": f"WHEN b = 0 AND a < 2 THEN pow(-1, a * (x // 4)) / 64 WHEN x // 4 = a % 2 THEN {_cosine_sql(8, 'b', 'y')} * {_cosine_sql(4, 'a // 2', 'x % 4')}",
}


def _small_block(kind: str) -> None:
    def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = smallblocks.small_coefficients(rasters.embedding_raster(spark, sf_dir), kind)
        return out.select("by", "bx", "v", "u", (F.round("coef", 6) + 0.0).alias("coef"))

    def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = smallblocks.small_samples(smallblocks.small_coefficients(rasters.embedding_raster(spark, sf_dir), kind), kind)
        return back.select("y", "x", F.round("v").cast("long").alias("v"))

    forward.__name__, roundtrip.__name__ = f"{kind}_forward", f"{kind}_roundtrip"
    _query(f"""WITH {_RASTER}, f AS (SELECT y // 8 AS "by", x // 8 AS bx, y % 8 AS y, x % 8 AS x, v AS s, count(*) OVER (PARTITION BY y // 8, x // 8) AS n FROM raster),
        k AS (SELECT *, CASE WHEN greatest(a, b) >= 4 THEN 4 WHEN greatest(a, b) >= 2 THEN 2 ELSE 1 END AS g FROM range(8) a(a), range(8) b(b), range(8) y(y), range(8) x(x)),
        m AS (SELECT a, b, y, x, (CASE {_SMALL[kind]} ELSE 0 END)::DOUBLE AS m FROM k)
        SELECT "by", bx, a AS v, b AS u, round(sum(s * m), 6) + 0.0 AS coef FROM f JOIN m USING (y, x) WHERE n = 64 GROUP BY ALL""")(forward)
    _query(f"WITH {_RASTER}, f AS (SELECT *, count(*) OVER (PARTITION BY y // 8, x // 8) AS n FROM raster) SELECT y, x, v FROM f WHERE n = 64")(roundtrip)


for _kind in smallblocks.KINDS:
    _small_block(_kind)


_QUANT = f"""{_DCT}, q AS (SELECT "by", bx, v, u, round(round(coef, 6) / 2)::BIGINT AS q FROM co)"""


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.block_coefficients(rasters.embedding_raster(spark, sf_dir))
    return out.select("image_id", "channel", "by", "bx", "v", "u", (F.col("v") * 8 + F.col("u")).alias("k"), F.round(F.round("coef", 6) / 2).cast("long").alias("q"))


@_query(f"""{_DCT}, q AS (SELECT v * 8 + u AS index, round(round(coef, 6) / 2)::BIGINT AS q FROM co), o AS ({_order_sql(1, 1)})
    SELECT place, o.index, count_if(q <> 0)::BIGINT AS nonzeros FROM o JOIN q USING (index) GROUP BY ALL""")
def natural_order_8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nonzero coefficients of the raster's blocks by place in the scan."""
    per = _quantised(spark, sf_dir).groupBy(F.col("k").cast("long").alias("index")).agg(F.count_if(F.col("q") != 0).alias("nonzeros"))
    return per.join(blocks.natural_order(spark), "index").select("place", "index", "nonzeros")


@_query(f"""WITH {_RASTER}, f AS (SELECT *, y // 16 AS "by", x // 32 AS bx, count(*) OVER (PARTITION BY y // 16, x // 32) AS n FROM raster),
    a AS (SELECT "by", bx, y % 16 AS iy, u, sum(v * {_cosine_sql(32, 'u', 'x % 32')}) AS s FROM f, range(32) r(u) WHERE n = 512 GROUP BY ALL),
    co AS (SELECT "by", bx, v, u, sum(s * {_cosine_sql(16, 'v', 'iy')}) AS coef FROM a, range(16) r(v) GROUP BY ALL),
    q AS (SELECT v * 32 + u AS index, round(round(coef, 6) / 2)::BIGINT AS q FROM co), o AS ({_order_sql(4, 2)})
    SELECT place, o.index, count_if(q <> 0)::BIGINT AS nonzeros FROM o JOIN q USING (index) GROUP BY ALL""")
def natural_order_32x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefs = coefficients(rasters.embedding_raster(spark, sf_dir), 16, 32)
    per = coefs.groupBy(F.col("place").cast("long").alias("index")).agg(F.count_if(F.round(F.round("coef", 6) / 2) != 0).alias("nonzeros"))
    return per.join(blocks.natural_order(spark, 4, 2), "index").select("place", "index", "nonzeros")


@_query(f"""{_QUANT} SELECT "by", bx, v, u, q, round(CASE WHEN q = 0 THEN 0.0 WHEN abs(q) = 1 THEN q * (1 - 0.05465007330715401) ELSE q - 0.145 / q END, 9) + 0.0 AS value FROM q""")
def dequantise_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _quantised(spark, sf_dir)
    return out.select("by", "bx", "v", "u", "q", (F.round(blocks.dequantise(F.col("q"), F.col("channel")), 9) + 0.0).alias("value"))


_COST = f"""{_QUANT}, cost AS (SELECT "by", bx, 3.5 * count_if(q <> 0 AND v + u > 0) + 0.25 * sum(CASE WHEN v + u > 0 THEN abs(q) ELSE 0 END) + 1 AS cost FROM q GROUP BY ALL)"""


@_query(f"""{_COST} SELECT "by", bx, cost::DOUBLE AS cost FROM cost""")
def transform_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.transform_cost(_quantised(spark, sf_dir), "by", "bx").select("by", "bx", F.col("cost").cast("double").alias("cost"))


@_query(f"""{_COST}, parts AS (SELECT "by" // 2 AS "by", bx // 2 AS bx, sum(cost)::DOUBLE AS parts, (3.5 + 0.75 * max(cost) * count(*))::DOUBLE AS own FROM cost GROUP BY 1, 2)
    SELECT "by", bx, least(parts, own) AS cost, own < parts AS whole FROM parts""")
def quadtree_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = blocks.transform_cost(_quantised(spark, sf_dir), "image_id", "by", "bx")
    own = costs.groupBy("image_id", F.floor(F.col("by") / 2).alias("by"), F.floor(F.col("bx") / 2).alias("bx")).agg((3.5 + 0.75 * F.max("cost") * F.count("*")).cast("double").alias("cost"))
    return blocks.merge_quads(costs, own).select("by", "bx", F.col("cost").cast("double").alias("cost"), "whole")


@_query(f"""{_QUANT}, nz AS (SELECT "by" AS y, bx AS x, count_if(q <> 0 AND v + u > 0)::BIGINT AS nz FROM q GROUP BY ALL),
    p AS (SELECT y, x, nz, lag(nz) OVER (PARTITION BY y ORDER BY x) AS l, lag(nz) OVER (PARTITION BY x ORDER BY y) AS t FROM nz),
    g AS (SELECT y, x, nz, coalesce((l + t + 1) >> 1, t, l, 32) AS predicted FROM p)
    SELECT y, x, nz, predicted, (15 * CASE WHEN least(64, predicted) < 8 THEN least(64, predicted) ELSE 4 + (least(64, predicted) >> 1) END)::BIGINT AS context FROM g""")
def nonzero_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _quantised(spark, sf_dir).groupBy("image_id", "channel", F.col("by").alias("y"), F.col("bx").alias("x")).agg(F.count_if((F.col("q") != 0) & (F.col("k") > 0)).alias("nz"))
    out = blocks.predicted_nonzeros(counts)
    return out.select("y", "x", "nz", "predicted", blocks.nonzero_context(F.col("predicted"), F.lit(0)).cast("long").alias("context"))


@_query(f"""{_DCT}, c AS (SELECT i // 8 AS y, i % 8 AS x FROM range(64) t(i)), t AS (SELECT [3150.0, 2110.5, 1055.25, 707.0175, 353.50875, 116.6578875]::DOUBLE[] AS bands),
    p AS (SELECT y, x, greatest(0, least(5, sqrt((y / 7.0) * (y / 7.0) + (x / 7.0) * (x / 7.0)) / sqrt(2.0) * 5)) AS pos FROM c),
    q AS (SELECT y, x, pos, least(4, floor(pos))::INTEGER AS k FROM p),
    w AS (SELECT y, x, bands[k + 1] * pow(bands[k + 2] / bands[k + 1], pos - k) AS weight FROM q, t)
    SELECT y, x, round(weight, 5) AS weight, round(sum(abs(round(coef, 6)) / weight), 6) AS steps FROM w JOIN co ON co.v = y AND co.u = x GROUP BY y, x, weight""")
def band_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, and how many steps of them the raster's coefficients are in all."""
    coefs = blocks.block_coefficients(rasters.embedding_raster(spark, sf_dir)).groupBy(F.col("v").cast("long").alias("y"), F.col("u").cast("long").alias("x")).agg(F.sum(F.abs(F.round("coef", 6))).alias("size"))
    both = coefs.join(blocks.band_weights(spark, BANDS), ["y", "x"])
    return both.select("y", "x", F.round("weight", 5).alias("weight"), F.round(F.col("size") / F.col("weight"), 6).alias("steps"))


@_query(f"""WITH {_RGB8}, f AS (SELECT y, x, y // 8 AS "by", x // 8 AS bx, r / 2550.0::DOUBLE AS c0, g / 2550.0::DOUBLE AS c1, b / 2550.0::DOUBLE AS c2 FROM rgb),
    s AS (SELECT *, {', '.join(f"coalesce(abs(lead({c}) OVER h - {c}), 0) + coalesce(abs(lead({c}) OVER d - {c}), 0) AS {c}_s" for c in ('c0', 'c1', 'c2'))} FROM f
          WINDOW h AS (PARTITION BY "by", bx, y ORDER BY x), d AS (PARTITION BY "by", bx, x ORDER BY y)),
    a AS (SELECT "by", bx, sqrt((0.35 * var_pop(c0) + var_pop(c1) + 0.15 * var_pop(c2)) / 1.5) + 0.5 * ((0.35 * sum(c0_s) + sum(c1_s) + 0.15 * sum(c2_s)) / 112 / 1.5) AS act FROM s GROUP BY ALL HAVING count(*) = 64)
    SELECT "by", bx, CASE WHEN act <= 1e-7 THEN 5 ELSE least(24, greatest(5, round(5 + least(1, greatest(0, act / 0.25)) * 19))) END::BIGINT AS qf FROM a""")
def adaptive_quantiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = rasters.embedding_pixels(spark, sf_dir).select("image_id", "y", "x", *[(F.col(k) / 2550.0).alias(f"c{i}") for i, k in enumerate("rgb")])
    return blocks.quantiser_field(pixels).select("by", "bx", "qf")


def _stencil_sql(reach: int, weight: str, mirror: bool) -> str:
    """weight: SQL over a, the smaller, and b, the larger of a neighbour's distances."""

    def edge(e: str, n: str) -> str:
        return f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END" if mirror else f"greatest(0, least({n} - 1, {e}))"

    return f"""WITH {_RASTER}, size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM raster),
        d AS (SELECT dy, dx, least(abs(dy), abs(dx)) AS a, greatest(abs(dy), abs(dx)) AS b FROM range({-reach}, {reach + 1}) i(dy), range({-reach}, {reach + 1}) j(dx)),
        u AS (SELECT dy, dx, ({weight})::DOUBLE AS u FROM d), o AS (SELECT dy, dx, u / (SELECT sum(u) FROM u) AS wt FROM u),
        p AS (SELECT r.y, r.x, r.v, wt, {edge('r.y + dy', 'h')} AS sy, {edge('r.x + dx', 'w')} AS sx FROM raster r, size, o)
        SELECT p.y, p.x, p.v::DOUBLE AS v, round(sum(wt * s.v), 6) AS filtered FROM p JOIN raster s ON s.y = sy AND s.x = sx GROUP BY ALL"""


@_query(_stencil_sql(1, "CASE a + b WHEN 0 THEN 1 WHEN 1 THEN 0.115169525 ELSE 0.061248592 END", False))
def gaborish(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stencils.stencil(rasters.embedding_raster(spark, sf_dir), stencils.gaborish_weights())
    return out.select("y", "x", "v", F.round("filtered", 6).alias("filtered"))


@_query(_stencil_sql(2, """CASE WHEN b = 0 THEN 1 WHEN a = 0 AND b = 1 THEN -0.09495815671340026 WHEN a = 1 AND b = 1 THEN -0.041031725066768575 WHEN a = 0 THEN 0.013710004822696948
    WHEN a = 1 THEN 0.006510206083837737 ELSE -0.0014789063378272242 END""", True))
def inverse_gaborish(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stencils.stencil(rasters.embedding_raster(spark, sf_dir), stencils.sharpen_weights(), stencils.mirrored)
    return out.select("y", "x", "v", F.round("filtered", 6).alias("filtered"))


def _smooth_sql() -> str:
    names = ("c0", "c1", "c2")
    sums = ", ".join(f"sum(CASE WHEN ad = 0 THEN 0.05226273532324128 WHEN ad = 1 THEN 0.20345139757231578 ELSE 0.0334829185968739 END * s.{c}) AS m_{c}" for c in names)
    gap = ", ".join(f"abs(c.{c} - m_{c}) / 4" for c in names)
    moved = ", ".join(f"round(c.{c} + CASE WHEN f IS NULL THEN 0 ELSE (m_{c} - c.{c}) * f END, 7) AS {c}" for c in names)
    return f"""WITH {_RGB8}, c AS (SELECT y, x, r::DOUBLE AS c0, g::DOUBLE AS c1, b::DOUBLE AS c2 FROM rgb),
        o AS (SELECT dy, dx, abs(dy) + abs(dx) AS ad FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
        m AS (SELECT c.y, c.x, {sums} FROM c, o JOIN c s ON s.y = c.y + dy AND s.x = c.x + dx WHERE c.y BETWEEN 1 AND (SELECT h - 2 FROM size) AND c.x BETWEEN 1 AND (SELECT w - 2 FROM size) GROUP BY ALL),
        g AS (SELECT m.*, greatest(0, least(1, 3 - 4 * greatest({gap}))) AS f FROM m JOIN c USING (y, x))
        SELECT c.y, c.x, {moved} FROM c LEFT JOIN g USING (y, x)"""


@_query(_smooth_sql())
def dc_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dc = rasters.embedding_pixels(spark, sf_dir).select("image_id", "y", "x", *[F.col(k).cast("double").alias(f"c{i}") for i, k in enumerate("rgb")])
    return stencils.smooth_dc(dc, (4.0, 4.0, 4.0)).select("y", "x", *[F.round(c, 7).alias(c) for c in ("c0", "c1", "c2")])


# ---- wider stencils, folds and sections ---------------------------------------------------------


def _edges_sql(step: int) -> str:
    def m(e: str, n: str) -> str:
        return f"CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END"

    near, cross = ("1 AND 2", "1 AND 1", "1 AND 1")[step], (1, 1, 0)[step]
    return f"""WITH {_RGB8}, p AS (SELECT y, x, r / 2550.0::DOUBLE AS c0, g / 2550.0::DOUBLE AS c1, b / 2550.0::DOUBLE AS c2, 16 / (1 + (y // 8 + x // 8) % 5)::DOUBLE * 0.27878788 * 5 / 7 AS sigma FROM rgb),
        o AS (SELECT dy, dx FROM range(-2, 3) i(dy), range(-2, 3) j(dx) WHERE abs(dy) + abs(dx) BETWEEN {near}), c AS (SELECT cy, cx FROM range(-1, 2) i(cy), range(-1, 2) j(cx) WHERE abs(cy) + abs(cx) <= {cross}),
        s AS (SELECT p.y, p.x, dy, dx, p.sigma, sum(40 * abs(a.c0 - b.c0) + 5 * abs(a.c1 - b.c1) + 3.5 * abs(a.c2 - b.c2)) AS sad FROM p, size, o, c JOIN p a ON a.y = {m('p.y + cy', 'h')} AND a.x = {m('p.x + cx', 'w')} JOIN p b ON b.y = {m('p.y + dy + cy', 'h')} AND b.x = {m('p.x + dx + cx', 'w')} GROUP BY ALL),
        w AS (SELECT y, x, dy, dx, greatest(0, 1 - sad * 1.1715728752538099::DOUBLE * CASE WHEN y % 8 IN (0, 7) OR x % 8 IN (0, 7) THEN 2 / 3.0::DOUBLE ELSE 1 END / (sigma * {(1.65, 1.0, 0.65)[step]}::DOUBLE)) AS w FROM s),
        t AS (SELECT w.y, w.x, sum(w.w) AS w, {', '.join(f'sum(w.w * n.c{c}) AS t{c}' for c in range(3))} FROM w, size JOIN p n ON n.y = {m('w.y + dy', 'h')} AND n.x = {m('w.x + dx', 'size.w')} GROUP BY ALL)
        SELECT p.y, p.x, {', '.join(f'round((p.c{c} + t{c}) / (1 + w), 7) AS c{c}' for c in range(3))} FROM p JOIN t USING (y, x)"""


def _edges(step: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels = rasters.embedding_pixels(spark, sf_dir)
        size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))  # a row an image
        quant = 1 + (F.floor(F.col("y") / 8) + F.floor(F.col("x") / 8)) % 5
        pixels = pixels.select("image_id", "y", "x", *[(F.col(k) / 2550.0).alias(f"c{i}") for i, k in enumerate("rgb")], tiles.block_sigma(quant, 5).alias("sigma")).join(size, "image_id")
        return tiles.preserve_edges(pixels, step, 24).select("y", "x", *[F.round(f"c{k}", 7).alias(f"c{k}") for k in range(3)])

    run.__name__ = f"edge_preserving_{step}"
    _query(_edges_sql(step))(run)


for _step in range(3):
    _edges(_step)


@_query(f"WITH {_RASTER} SELECT y, x, v FROM raster")
def squeeze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrences.unsqueeze(recurrences.squeeze(rasters.embedding_raster(spark, sf_dir))).select("y", "x", "v")


@_query(f"{_RESIDUALS}, o AS (SELECT y, x, token, row_number() OVER (PARTITION BY y ORDER BY x) - 1 AS place FROM tok) SELECT y, place, token FROM o")
def rans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = neighbours.residual_tokens(rasters.embedding_raster(spark, sf_dir))
    table = entropy.cumulative(entropy.frequencies(entropy.histogram(tokens)))
    return recurrences.unrans_sections(recurrences.rans_sections(tokens, table, "y", "x"), table, "y")


@_query("""WITH RECURSIVE n AS (SELECT n_regionkey AS k, list((n_nationkey * 7) ORDER BY n_nationkey) AS raw FROM nation GROUP BY 1),
    c AS (SELECT k, list_transform(raw, lambda v, i: (v % (len(raw) - i + 1))::BIGINT) AS code FROM n),
    s(k, code, i, rest, out) AS (
        SELECT k, code, 1, range(0, len(code)), []::BIGINT[] FROM c
        UNION ALL SELECT k, code, i + 1, list_filter(rest, lambda v: v <> rest[code[i] + 1]), list_append(out, rest[code[i] + 1]) FROM s WHERE i <= len(code))
    SELECT k, array_to_string(code, ',') AS code, array_to_string(out, ',') AS permutation FROM s WHERE i = len(code) + 1""")
def lehmer_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("raw"))
    code = F.transform("raw", lambda v, i: ((v * 7) % (F.size("raw") - i)).cast("long"))
    rows = rows.select("k", code.alias("code")).withColumn("out", recurrences.permutation(F.col("code")))
    return rows.select("k", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(n) for c, n in (("code", "code"), ("out", "permutation"))])


@_query("""WITH RECURSIVE c AS (SELECT user_id, list((event_id * 5 % 16)::BIGINT ORDER BY event_id) AS p FROM events GROUP BY 1),
    s(user_id, p, i, ord, out) AS (
        SELECT user_id, p, 1, range(0, 16), []::BIGINT[] FROM c
        UNION ALL SELECT user_id, p, i + 1, list_concat([ord[p[i] + 1]], list_filter(ord, lambda v: v <> ord[p[i] + 1])), list_append(out, ord[p[i] + 1]) FROM s WHERE i <= len(p))
    SELECT user_id, array_to_string(out, ',') AS symbols FROM s WHERE i = len(p) + 1""")
def inverse_move_to_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = rasters.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 5 % 16).alias("place"))
    symbols = recurrences.unmove_to_front(places, "user_id", "event_id", 16)
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "symbol")))
    return symbols.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda e: e["symbol"].cast("string")), ",").alias("symbols"))


@_query(f"""{_QUANT}, m AS (SELECT q, count(*) AS n FROM q GROUP BY q), c AS (SELECT q, n, CASE WHEN q = 0 THEN 0 ELSE floor(log2(abs(q)))::INTEGER + 1 END AS category FROM m)
    SELECT q, n, category, CASE WHEN q >= 0 THEN q ELSE q + (1::BIGINT << category) - 1 END AS bits, q AS back FROM c""")
def jpeg_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantised(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n"))
    category, bits = codes.magnitude(F.col("q"))
    rows = rows.select("q", "n", category.alias("category"), bits.cast("long").alias("bits"))
    return rows.withColumn("back", codes.extend(F.col("category"), F.col("bits")).cast("long"))


@_query("SELECT doc_id, ((n_chars > 300)::INTEGER + (n_chars > 1000)::INTEGER + (n_chars > 5000)::INTEGER)::INTEGER AS bucket, least(3, greatest(0, n_chars - 2))::BIGINT AS distance_context FROM documents")
def threshold_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rasters.table(spark, sf_dir, "documents")
    return docs.select("doc_id", codes.threshold_bucket(F.col("n_chars"), [300, 1000, 5000]).cast("int").alias("bucket"), codes.distance_context(F.col("n_chars")).cast("long").alias("distance_context"))


@_query("""WITH f AS (SELECT p_partkey, p_size * 13 AS w, p_size * 7 + p_partkey % 50 AS h, 1 + p_partkey % 2 AS sh, 1 + p_partkey % 2 AS sv FROM part)
    SELECT p_partkey, ceil(ceil(w * sh / 2.0) / 8)::BIGINT AS visible_x, ceil(ceil(h * sv / 2.0) / 8)::BIGINT AS visible_y, (ceil(w / 16.0) * sh)::BIGINT AS stored_x, (ceil(h / 16.0) * sv)::BIGINT AS stored_y FROM f""")
def jpeg_block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = rasters.table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("long")
    found = codes.mcu_layout(size * 13, size * 7 + key % 50, 1 + key % 2, 1 + key % 2, F.lit(2), F.lit(2))
    return part.select("p_partkey", *[c.cast("long").alias(n) for c, n in zip(found, ("visible_x", "visible_y", "stored_x", "stored_y"), strict=True)])


@_query(f"""WITH {_RASTER}, {_near()}, r AS (SELECT x // 16 AS gx, abs(w - nw) AS prop, {_ZIGZAG.format(r=f'(v - {_GRADIENT})')} AS u FROM near), t AS (SELECT gx, prop, {_TOKEN} AS token FROM r),
    cuts AS (SELECT DISTINCT gx, prop AS threshold FROM t), c AS (SELECT cuts.gx, threshold, prop > threshold AS side, token, count(*) AS n FROM cuts JOIN t ON t.gx = cuts.gx GROUP BY ALL),
    s AS (SELECT gx, threshold, side, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM c GROUP BY ALL),
    b AS (SELECT gx, threshold, round(sum(bits), 6) AS bits FROM s GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT gx, threshold, bits FROM b QUALIFY row_number() OVER (PARTITION BY gx ORDER BY bits, threshold) = 1""")
def entropy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = neighbours.residual_tokens(rasters.embedding_raster(spark, sf_dir))
    tokens = tokens.select(F.floor(F.col("x") / 16).alias("gx"), F.abs(F.col("w") - F.col("nw")).alias("prop"), "token")
    return entropy.best_split(tokens, "gx", "prop")


@_query(f"WITH {_RASTER} SELECT y, x, v FROM raster")
def weighted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.weighted_samples(weighted.weighted_residuals(rasters.embedding_raster(spark, sf_dir))).select("y", "x", "v")


# ---- contexts, strategies and small formats -----------------------------------------------------


@_query(f"""WITH {_PIXELS}, s AS (SELECT a, b, c, (a - 25) / 1000.0::DOUBLE AS x, b / 20.0::DOUBLE + 0.2::DOUBLE AS y, c / 20.0::DOUBLE AS z, 0.0037930732552754493::DOUBLE AS k FROM px),
    l AS (SELECT a, b, c, pow(y + x + cbrt(k), 3) - k AS l, pow(y - x + cbrt(k), 3) - k AS m, pow(z + cbrt(k), 3) - k AS s FROM s)
    SELECT a, b, c, round(11.031566901960783::DOUBLE * l - 9.866943921568629::DOUBLE * m - 0.16462299647058826::DOUBLE * s, 8) + 0.0 AS red,
           round(-3.254147380392157::DOUBLE * l + 4.418770392156863::DOUBLE * m - 0.16462299647058826::DOUBLE * s, 8) + 0.0 AS green,
           round(-3.6588512862745097::DOUBLE * l + 2.7129230470588235::DOUBLE * m + 1.9459282392156863::DOUBLE * s, 8) + 0.0 AS blue FROM l""")
def xyb_to_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    xyb = (F.col("a") - 25) / 1000.0, F.col("b") / 20.0 + 0.2, F.col("c") / 20.0
    found = contexts.xyb_to_linear(*xyb, codes.OPSIN_BIAS)
    return rasters.lineitem_pixels(spark, sf_dir).select("a", "b", "c", *[(F.round(v, 8) + 0.0).alias(n) for v, n in zip(found, ("red", "green", "blue"), strict=True)])


_FREQUENCY_PARTS = [
    0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15, 16, 16, 17, 17, 18, 18, 19, 19, 20, 20, 21, 21, 22, 22,
    23, 23, 23, 23, 24, 24, 24, 24, 25, 25, 25, 25, 26, 26, 26, 26, 27, 27, 27, 27, 28, 28, 28, 28, 29, 29, 29, 29, 30, 30, 30, 30,
]
_NONZERO_PARTS = [
    0, 0, 31, 62, 62, 93, 93, 93, 93, 123, 123, 123, 123, 152, 152, 152, 152, 152, 152, 152, 152, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180,
    180, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206,
]


@_query(f"""{_QUANT}, ord AS ({_order_sql(1, 1)}),
    s AS (SELECT place, count_if(q <> 0) OVER w AS l, lag(q) OVER o AS before, count_if(q <> 0) OVER a AS nz FROM (SELECT "by", bx, place, q FROM q JOIN ord ON index = v * 8 + u WHERE place > 0)
          WINDOW o AS (PARTITION BY "by", bx ORDER BY place), a AS (PARTITION BY "by", bx), w AS (PARTITION BY "by", bx ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT (555 + 7 * 458 + 2 * (({_NONZERO_PARTS})[(l + 1)::BIGINT] + ({_FREQUENCY_PARTS})[place + 1]) + CASE WHEN before IS NULL THEN nz <= 4 ELSE before <> 0 END::INTEGER)::BIGINT AS context, count(*) AS n
    FROM s WHERE l > 0 GROUP BY 1""")
def zero_density_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of each block in scan order while non-zeros are left; the first goes by whether over 4 are not zero."""
    order = F.broadcast(blocks.natural_order(spark).select("place", F.col("index").alias("k")))
    block = Window.partitionBy("image_id", "channel", "by", "bx")
    odd = F.when(F.col("q") != 0, 1).otherwise(0)
    rows = _quantised(spark, sf_dir).join(order, "k").where("place > 0")
    left, total = F.sum(odd).over(block.orderBy("place").rowsBetween(0, Window.unboundedFollowing)), F.sum(odd).over(block)
    rows = rows.select("channel", "place", left.alias("left"), F.coalesce(F.lag(odd).over(block.orderBy("place")), F.when(total > 4, 0).otherwise(1)).alias("before"))
    found = contexts.zero_density_context(F.col("left"), F.col("place"), 0, F.col("before"), contexts.block_context(F.col("channel"), F.lit(0)))
    return rows.where(F.col("left") > 0).groupBy(found.cast("long").alias("context")).agg(F.count("*").alias("n"))


@_query("""WITH s AS (SELECT p_partkey, p_partkey % 28 AS s, p_size % 3 AS channel FROM part),
    d AS (SELECT *, [1, 1, 1, 1, 2, 4, 1, 2, 1, 4, 2, 4, 1, 1, 1, 1, 1, 1, 8, 4, 8, 16, 8, 16, 32, 16, 32][s + 1] AS cells_x, [1, 1, 1, 1, 2, 4, 2, 1, 4, 1, 4, 2, 1, 1, 1, 1, 1, 1, 8, 8, 4, 16, 16, 8, 32, 32, 16][s + 1] AS cells_y,
        CASE WHEN s BETWEEN 14 AND 17 THEN 1 WHEN s = 4 THEN 2 WHEN s = 5 THEN 3 WHEN s IN (6, 7) THEN 4 WHEN s IN (8, 9) THEN 5 WHEN s IN (10, 11) THEN 6 WHEN s = 18 THEN 7 WHEN s IN (19, 20) THEN 8
             WHEN s = 21 THEN 9 WHEN s IN (22, 23) THEN 10 WHEN s = 24 THEN 11 WHEN s IN (25, 26) THEN 12 ELSE 0 END AS bucket FROM s)
    SELECT p_partkey, cells_x, cells_y, bucket, CASE WHEN channel = 1 THEN CASE WHEN bucket < 3 THEN bucket WHEN bucket = 3 THEN 2 WHEN bucket < 6 THEN 3 ELSE least(6, bucket - 2) END
        ELSE CASE WHEN bucket < 3 THEN 7 + bucket ELSE least(14, 6 + bucket) END END AS context FROM d""")
def block_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy, channel = F.col("p_partkey") % 28, F.col("p_size") % 3
    (x, y), bucket = contexts.strategy_cells(strategy), contexts.strategy_order(strategy)
    found = {"cells_x": x, "cells_y": y, "bucket": bucket, "context": contexts.block_context(channel, bucket)}
    return rasters.table(spark, sf_dir, "part").select("p_partkey", *[c.cast("int").alias(n) for n, c in found.items()])


@_query("SELECT least(7, CASE WHEN n_chars = 0 THEN 0 ELSE floor(log2(n_chars)) + 1 END)::INTEGER AS context, count(*) AS n FROM documents GROUP BY 1")
def order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.table(spark, sf_dir, "documents").groupBy(contexts.order_context(F.col("n_chars")).cast("int").alias("context")).agg(F.count("*").alias("n"))


@_query(f"""WITH {_RASTER}, {_near()}, p AS (SELECT w - nw AS p FROM near)
    SELECT CASE WHEN p > 0 THEN 0 ELSE 1 END AS of_2, CASE WHEN p > 0 THEN CASE WHEN p > 20 THEN 0 ELSE 1 END WHEN p > -20 THEN 2 ELSE 3 END AS of_4,
        CASE WHEN p > 0 THEN CASE WHEN p > 20 THEN CASE WHEN p > 40 THEN 0 ELSE 1 END WHEN p > 8 THEN 2 ELSE 3 END
             WHEN p > -20 THEN CASE WHEN p > -8 THEN 4 ELSE 5 END WHEN p > -40 THEN 6 ELSE 7 END AS of_8, count(*) AS n FROM p GROUP BY ALL""")
def activity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    change, cuts = F.col("w") - F.col("nw"), {"of_2": (0,), "of_4": (-20, 0, 20), "of_8": (-40, -20, -8, 0, 8, 20, 40)}
    bins = [contexts.activity_bin(change, t).cast("int").alias(n) for n, t in cuts.items()]
    return neighbours.neighbours(rasters.embedding_raster(spark, sf_dir)).groupBy(*bins).agg(F.count("*").alias("n"))


@_query(f"""WITH {_RASTER}, tiles AS (SELECT *, y // 16 AS gy, x // 16 AS gx FROM raster), {_near('tiles', 'gy, gx')},
    r AS (SELECT y, x, v - CASE WHEN n0 IS NULL AND x0 IS NULL THEN 0 WHEN n0 IS NULL THEN w WHEN x0 IS NULL THEN n ELSE {_GRADIENT} END AS r FROM near)
    SELECT y, x, {_ZIGZAG.format(r='r')} AS u FROM r""")
def slice_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = neighbours.tiled(rasters.embedding_raster(spark, sf_dir), 16)
    return neighbours.plane_residuals(slices, ("image_id", "channel", "gy", "gx")).select("y", "x", codes.zigzag(F.col("residual")).alias("u"))


@_query("""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS pos FROM t),
    bb AS (SELECT doc_id, pos, ('0x' || substr(h, 2 * pos + 1, 2))::INTEGER AS b FROM p),
    pr AS (SELECT coalesce(lag(b) OVER w, 0) AS a, coalesce(lag(b, 2) OVER w, 0) AS b FROM bb WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT a, b, count(*) AS n FROM pr GROUP BY ALL),
    k AS (SELECT n, a & 63 AS lsb6, a >> 2 AS msb6,
        CASE WHEN a >= 192 THEN 2 + a % 2 WHEN a >= 128 THEN a % 2 WHEN a IN (9, 10, 13) THEN 4 WHEN a < 32 OR a = 127 THEN 0 WHEN a = 32 THEN 8 WHEN a IN (34, 39) THEN 16 WHEN a = 37 THEN 20
             WHEN a IN (40, 60, 91, 123) THEN 24 WHEN a IN (41, 62, 93, 125) THEN 28 WHEN a IN (44, 58, 59) THEN 32 WHEN a = 46 THEN 36 WHEN a = 61 THEN 40 WHEN a BETWEEN 48 AND 57 THEN 44
             WHEN a IN (65, 69, 73, 79, 85) THEN 48 WHEN a BETWEEN 65 AND 90 THEN 52 WHEN a IN (97, 101, 105, 111, 117) THEN 56 WHEN a BETWEEN 97 AND 122 THEN 60 ELSE 12 END
        | CASE WHEN b <= 32 OR b BETWEEN 127 AND 223 THEN 0 WHEN b >= 224 THEN 2 WHEN b BETWEEN 97 AND 122 THEN 3 WHEN b BETWEEN 65 AND 90 OR b BETWEEN 48 AND 57 THEN 2 ELSE 1 END AS utf8,
        8 * CASE WHEN a = 255 THEN 7 WHEN a >= 240 THEN 6 WHEN a >= 192 THEN 5 WHEN a >= 128 THEN 4 WHEN a >= 64 THEN 3 WHEN a >= 16 THEN 2 ELSE (a > 0)::INTEGER END
        + CASE WHEN b = 255 THEN 7 WHEN b >= 240 THEN 6 WHEN b >= 192 THEN 5 WHEN b >= 128 THEN 4 WHEN b >= 64 THEN 3 WHEN b >= 16 THEN 2 ELSE (b > 0)::INTEGER END AS signed FROM g)
    SELECT mode, context, sum(n)::BIGINT AS n FROM (SELECT n, unnest([{'m': 'lsb6', 'c': lsb6}, {'m': 'msb6', 'c': msb6}, {'m': 'utf8', 'c': utf8}, {'m': 'signed', 'c': signed}]) AS e FROM k), LATERAL (SELECT e.m AS mode, e.c AS context) GROUP BY 1, 2""")
def literal_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of the texts by the two bytes before it (0 before the first): pairs are counted, then given a context in each mode."""
    rows = rasters.table(spark, sf_dir, "documents").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t")).where("length(t) > 0")
    at = rows.select("t", F.explode(F.expr("sequence(0, length(t) - 1)")).alias("pos"))
    pair = F.expr("CASE pos WHEN 0 THEN X'0000' WHEN 1 THEN X'00' || substring(t, 1, 1) ELSE substring(t, pos - 1, 2) END")
    pairs = at.groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))
    before, last = (F.conv(F.hex(F.substring("pair", k, 1)), 16, 10).cast("int") for k in (1, 2))
    pairs = pairs.select("n", last.alias("last"), before.alias("before"))
    modes = [F.struct(F.lit(m).alias("mode"), contexts.literal_context(m, F.col("last"), F.col("before")).cast("int").alias("context")) for m in ("lsb6", "msb6", "utf8", "signed")]
    return pairs.select("n", F.inline(F.array(*modes))).groupBy("mode", "context").agg(F.sum("n").alias("n"))


@_query("""WITH h AS (SELECT p_partkey, (p_partkey * 37 % 31744)::BIGINT AS m, p_partkey % 2 AS s FROM part)
    SELECT p_partkey, (1 - 2 * s) * CASE WHEN m < 1024 THEN m * pow(2.0::DOUBLE, -24) ELSE (1024 + m % 1024) * pow(2.0::DOUBLE, m // 1024 - 25) END AS value FROM h""")
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.col("p_partkey") * 37 % 31744 + F.col("p_partkey") % 2 * 32768
    return rasters.table(spark, sf_dir, "part").select("p_partkey", contexts.half_to_double(bits).alias("value"))


@_query("""WITH f AS (SELECT p_partkey, p_size * 13 AS w, p_size * 7 + p_partkey % 50 AS h, 1 + p_partkey % 2 AS s FROM part),
    g AS (SELECT p_partkey, ceil(ceil(w * s / 2.0) / 8)::BIGINT AS across, ceil(ceil(h * s / 2.0) / 8)::BIGINT AS down, (ceil(w / 16.0) * s)::BIGINT AS stored FROM f)
    SELECT p_partkey, p_partkey % 97 AS ordinal, CASE WHEN p_partkey % 97 < across * down THEN p_partkey % 97 // across * stored + p_partkey % 97 % across END::BIGINT AS at FROM g""")
def jpeg_storage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = jpeg_block_layout(spark, sf_dir).withColumn("ordinal", F.col("p_partkey") % 97)
    return grid.select("p_partkey", "ordinal", contexts.storage_index(F.col("ordinal"), F.col("visible_x"), F.col("visible_y"), F.col("stored_x")).cast("long").alias("at"))


@_query("""WITH b AS (SELECT doc_id, lang IS NOT NULL AND (doc_id % 2 = 0 OR source IS NOT NULL) AS complete, 5 + coalesce(4 + strlen(lang), 0) + coalesce(6 + strlen(source), 0) AS bytes FROM documents)
    SELECT doc_id, complete, bytes, bytes <= 22 AS fits FROM b""")
def metadata_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(*[c for n in ("lang", "source") for c in (F.lit(n), F.col(n).cast("binary"))])
    required = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("lang"))).otherwise(F.array(F.lit("lang"), F.lit("source")))
    complete, size, fits = layout.metadata_check(F.map_filter(given, lambda _, v: v.isNotNull()), required, 22, 5)
    return rasters.table(spark, sf_dir, "documents").select("doc_id", complete.alias("complete"), size.alias("bytes"), fits.alias("fits"))


@_query(f"""WITH {_RASTER} SELECT x, y, v FROM raster WHERE NOT (x BETWEEN 4 AND 35 AND y BETWEEN 10 AND 109)
    UNION ALL SELECT x - 4, y - 90, v FROM raster WHERE x BETWEEN 8 AND 39 AND y BETWEEN 100 AND 199""")
def rectangle_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = rasters.embedding_raster(spark, sf_dir)
    return layout.paste(image, layout.crop(image, 8, 100, 32, 100), 4, 10, 32, 100).select("x", "y", "v")


# further queries register themselves here
from tesselune.plans import adaptive, formats, learning, transforms  # noqa: E402, F401
