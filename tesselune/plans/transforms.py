"""Registered queries of the large transforms and of block placement, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselune.operators import codelengths, entropy, jpeg, neighbours, placement, reconstruction, search, transforms
from tesselune.plans.queries import _RASTER, _RESIDUALS, _SMALL, _cosine_sql, _query
from tesselune.sources import rasters

# a thousandth of a millionth is added before rounding, as many values lie halfway between two sixth decimals


def _forward_sql(rows: int, columns: int, name: str = "co") -> str:
    """CTE ``name`` ("by", bx, v, u, coef) by two joins with cosines."""
    return f"""{name}_f AS (SELECT *, y // {rows} AS "by", x // {columns} AS bx, count(*) OVER (PARTITION BY y // {rows}, x // {columns}) AS n FROM raster),
    {name}_a AS (SELECT "by", bx, y % {rows} AS iy, u, sum(v * {_cosine_sql(columns, 'u', f'x % {columns}')}) AS s FROM {name}_f, range({columns}) r(u) WHERE n = {rows * columns} GROUP BY ALL),
    {name} AS (SELECT "by", bx, v, u, sum(s * {_cosine_sql(rows, 'v', 'iy')}) AS coef FROM {name}_a, range({rows}) r(v) GROUP BY ALL)"""


def _large(rows: int, columns: int) -> None:
    place = f"u * {rows} + v" if rows >= columns else f"v * {columns} + u"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = transforms.coefficients(rasters.embedding_raster(spark, sf_dir), rows, columns)
        return out.select("by", "bx", "v", "u", "place", (F.round(F.col("coef") + 1e-9, 6) + 0.0).alias("coef"))

    run.__name__ = f"dct_{rows}x{columns}"
    _query(f"""WITH {_RASTER}, {_forward_sql(rows, columns)}
        SELECT "by", bx, v::INTEGER AS v, u::INTEGER AS u, ({place})::INTEGER AS place, round(coef + 1e-9, 6) + 0.0 AS coef FROM co""")(run)


for _rows, _columns in transforms.LARGE.values():
    _large(_rows, _columns)

_SHAPES = ((16, 16), (32, 16), (8, 32), (64, 64))
#: By how much low frequencies of 2, 4 and 8 cells exceed those of the cells' means.
_SCALES = """scales(c, k, s) AS (VALUES (1, 0, 1.0::DOUBLE), (2, 0, 1.0), (2, 1, 1.108937353592731823), (4, 0, 1.0), (4, 1, 1.025760096781116015), (4, 2, 1.108937353592731823), (4, 3, 1.270559368765487251),
    (8, 0, 1.0), (8, 1, 1.0063534990068217), (8, 2, 1.0257600967811158), (8, 3, 1.0593017296817173), (8, 4, 1.1089373535927318), (8, 5, 1.1777765381970435), (8, 6, 1.2705593687654873), (8, 7, 1.3944898413647777))"""


def _cells_sql(rows: int, columns: int) -> str:
    h, w, name = rows // 8, columns // 8, f"co{rows}_{columns}"
    wave = lambda n, i, k: f"(CASE WHEN {k} = 0 THEN 1.0 ELSE sqrt(2.0) END * cos(({i} + 0.5) * {k} * pi() / {n}))"
    return f"""SELECT {rows} AS "rows", {columns} AS columns, "by" * {h} + y AS y, bx * {w} + x AS x, round(sum(coef / (sy.s * sx.s) * {wave(h, 'y', 'v')} * {wave(w, 'x', 'u')}) + 1e-9, 6) + 0.0 AS dc
        FROM {name} JOIN scales sy ON sy.c = {h} AND sy.k = v JOIN scales sx ON sx.c = {w} AND sx.k = u, range({h}) a(y), range({w}) b(x) GROUP BY ALL"""


@_query(f"""WITH {_RASTER}, {_SCALES}, {', '.join(_forward_sql(r, c, f'co{r}_{c}') for r, c in _SHAPES)} {' UNION ALL '.join(_cells_sql(r, c) for r, c in _SHAPES)}""")
def block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = rasters.embedding_raster(spark, sf_dir)
    parts = [transforms.cell_plane(raster, r, c).select(F.lit(r).alias("rows"), F.lit(c).alias("columns"), "y", "x", (F.round(F.col("v") + 1e-9, 6) + 0.0).alias("dc")) for r, c in _SHAPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(f"""WITH {_RASTER}, {', '.join(_forward_sql(r, c, f'co{r}_{c}') for r, c in _SHAPES)}
    {' UNION ALL '.join(f'SELECT {r} AS "rows", {c} AS columns, "by", bx, v::INTEGER AS v, u::INTEGER AS u, round(coef + 1e-9, 6) + 0.0 AS coef FROM co{r}_{c} WHERE v < {r // 8} AND u < {c // 8}' for r, c in _SHAPES)}""")
def block_low_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the plane of cells alone; the SQL takes the same corner from the whole transform."""
    raster, out = rasters.embedding_raster(spark, sf_dir), None
    for r, c in _SHAPES:
        lows = transforms.low_frequencies(transforms.cell_plane(raster, r, c), r, c)
        lows = lows.select(F.lit(r).alias("rows"), F.lit(c).alias("columns"), "by", "bx", "v", "u", (F.round(F.col("coef") + 1e-9, 6) + 0.0).alias("coef"))
        out = lows if out is None else out.unionByName(lows)
    return out


@_query(f"""WITH {_RASTER}, {_forward_sql(32, 16)}, b AS (SELECT "by", bx, v, u, round(coef, 3) AS q FROM co),
    a AS (SELECT "by", bx, v, x, sum(q * 16 * {_cosine_sql(16, 'u', 'x')}) AS s FROM b, range(16) r(x) GROUP BY ALL)
    SELECT "by" * 32 + y AS y, bx * 16 + x AS x, round(sum(s * 32 * {_cosine_sql(32, 'v', 'y')}), 4) + 0.0 AS v FROM a, range(32) r(y) GROUP BY ALL""")
def dct_32x16_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of coefficients rounded to thousandths, so the inverse is not just the input."""
    coefs = transforms.coefficients(rasters.embedding_raster(spark, sf_dir), 32, 16).withColumn("coef", F.round("coef", 3))
    return transforms.block_samples(coefs, 32, 16).select("y", "x", (F.round("v", 4) + 0.0).alias("v"))


_PLACED = """e AS (SELECT user_id AS image_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
        CASE WHEN event_id % 11 = 0 THEN 4 WHEN event_id % 7 = 0 THEN 6 WHEN event_id % 13 = 0 THEN 7 WHEN event_id % 97 = 0 THEN 99 ELSE event_id % 4 END AS strategy, event_id % 300 - 5 AS raw FROM events)"""
_MAP_SQL = f"""WITH RECURSIVE {_PLACED},
    shapes(id, w, h) AS (VALUES (0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 2), (6, 1, 2), (7, 2, 1)),
    s AS (SELECT DISTINCT image_id, 0::BIGINT AS i, [0, 0, 0, 0, 0, 0]::BIGINT[] AS tops, 'ok' AS status, NULL::BIGINT AS y, NULL::BIGINT AS x, NULL::BIGINT AS w, NULL::BIGINT AS h, 0::BIGINT AS o, n // 6 AS height FROM e
        UNION ALL
        SELECT image_id, i + 1, CASE WHEN next = 'ok' THEN list_transform(tops, lambda t, k: CASE WHEN k > nx AND k <= nx + nw THEN ny + nh ELSE t END) ELSE tops END, next, ny, nx, nw, nh, no, height
        FROM (SELECT *, CASE WHEN ny >= height THEN 'full' WHEN nw IS NULL OR nx + nw > 6 OR ny + nh > height THEN 'bounds' WHEN list_max(tops[nx + 1 : nx + nw]) > ny THEN 'overlap' ELSE 'ok' END AS next
              FROM (SELECT s.image_id, s.i, s.tops, s.height, list_min(tops) AS ny, list_position(tops, list_min(tops)) - 1 AS nx, shapes.w::BIGINT AS nw, shapes.h::BIGINT AS nh, s.o + coalesce(s.w * s.h, 0) * 64 AS no
                    FROM s JOIN e ON e.image_id = s.image_id AND e.i = s.i LEFT JOIN shapes ON shapes.id = e.strategy WHERE s.status = 'ok'))),
    last AS (SELECT image_id, height, CASE WHEN status = 'ok' AND list_min(tops) < height THEN 'incomplete' ELSE status END AS status, i - (status <> 'ok')::BIGINT AS placed, o + coalesce(CASE WHEN status = 'ok' THEN w * h END, 0) * 64 AS size
             FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i DESC) = 1)"""


@_query(f"{_MAP_SQL} SELECT image_id, height, status, placed, size FROM last")
def strategy_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.map_status(*_placed(spark, sf_dir)).select("image_id", "height", "status", "placed", "size")


@_query(f"""{_MAP_SQL} SELECT s.image_id, s.i - 1 AS i, strategy, x, y, w, h, greatest(1, least(256, raw + 1)) AS quantisation, o AS "offset"
    FROM s JOIN e ON e.image_id = s.image_id AND e.i = s.i - 1 WHERE s.i > 0 AND s.status = 'ok'""")
def strategy_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.placements(*_placed(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The strategies of each user's events, as an image six cells wide, and the images' heights."""
    e = F.col("event_id")
    strategy = F.when(e % 11 == 0, 4).when(e % 7 == 0, 6).when(e % 13 == 0, 7).when(e % 97 == 0, 99).otherwise(e % 4)
    rows = rasters.table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), e.alias("i"), strategy.cast("long").alias("strategy"), (e % 300 - 5).alias("raw"))
    return rows, rows.groupBy("image_id").agg(F.lit(6).cast("long").alias("width"), F.floor(F.count("*") / 6).alias("height"))


_SCALE = 0.1


def _cost_sql(name: str, rows: int, columns: int, way: str | None = None) -> str:
    """CTE ``name`` ("by", bx, cost) of blocks of a shape, or of cells transformed in another way."""
    h, w = rows // 8, columns // 8
    if way:
        coefs = f"""{name}_co AS (SELECT f.y // 8 AS "by", f.x // 8 AS bx, a AS v, b AS u, sum(f.v * m) AS coef FROM {name}_full f JOIN (
            SELECT a, b, y, x, (CASE {_SMALL[way]} ELSE 0 END)::DOUBLE AS m FROM (SELECT *, CASE WHEN greatest(a, b) >= 4 THEN 4 WHEN greatest(a, b) >= 2 THEN 2 ELSE 1 END AS g FROM range(8) a(a), range(8) b(b), range(8) y(y), range(8) x(x)))
            m ON m.y = f.y % 8 AND m.x = f.x % 8 GROUP BY ALL)"""
        coefs = f"""{name}_full AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY y // 8, x // 8) AS n FROM raster) WHERE n = 64), {coefs}"""
    else:
        coefs = _forward_sql(rows, columns, f"{name}_co")
    extra, spread = ("", "0") if h * w == 1 else (f"""{name}_dc AS (SELECT "by", bx, y, x, round(round(sum(coef / (sy.s * sx.s) * CASE WHEN v = 0 THEN 1.0 ELSE sqrt(2.0) END * cos((y + 0.5) * v * pi() / {h}) * CASE WHEN u = 0 THEN 1.0 ELSE sqrt(2.0) END * cos((x + 0.5) * u * pi() / {w})), 6)) AS dc
        FROM {name}_co JOIN scales sy ON sy.c = {h} AND sy.k = v JOIN scales sx ON sx.c = {w} AND sx.k = u, range({h}) a(y), range({w}) b(x) GROUP BY ALL),
        {name}_sp AS (SELECT "by", bx, max(dc) - min(dc) AS spread FROM {name}_dc GROUP BY ALL),""", "any_value(spread)")
    join = "" if h * w == 1 else f'JOIN {name}_sp USING ("by", bx)'
    oblong = 0.5 if rows != columns else 0
    more = "" if h * w == 1 else f" + {spread} * {h * w} + count_if(q <> 0) * {h + w}"
    return f"""{coefs}, {extra} {name}_q AS (SELECT "by", bx, round(round(coef, 6) * {_SCALE}::DOUBLE) AS q FROM {name}_co WHERE NOT (v < {h} AND u < {w})),
    {name} AS (SELECT "by" AS y, bx AS x, (3.5 * count_if(q <> 0) + 0.25 * sum(abs(q)) + 1 + {oblong}{more})::DOUBLE AS cost FROM {name}_q {join} GROUP BY ALL)"""


def _tried_sql() -> str:
    """CTE l8: each cell's best way, tried in turn."""
    out = [_cost_sql(f"w{k}", 8, 8, way) for k, way in enumerate(search.WAYS)]
    steps = "SELECT y, x, 0::BIGINT AS id, cost, cost AS plain FROM c8"
    for k, identifier in enumerate(search.WAYS.values()):
        steps = f"SELECT s.y, s.x, CASE WHEN plain > 6.5 AND w{k}.cost + 0.5 < s.cost THEN {identifier} ELSE id END AS id, CASE WHEN plain > 6.5 AND w{k}.cost + 0.5 < s.cost THEN w{k}.cost ELSE s.cost END AS cost, plain FROM ({steps}) s JOIN w{k} USING (y, x)"
    return f"""{_cost_sql('c8', 8, 8)}, {', '.join(out)}, l8 AS (SELECT y, x, cost, [[id, y, x, 1, 1]::BIGINT[]] AS leaves FROM ({steps}))"""


def _level_sql(n: int) -> str:
    half, ids = n // 2, {v: k for k, v in transforms.LARGE.items()}
    parts = [_cost_sql(f"c{n}", n, n), _cost_sql(f"t{n}", half, n), _cost_sql(f"s{n}", n, half)]
    leaf = lambda name, rows, columns: f"[{ids[rows, columns]}, {name}.y * {rows // 8}, {name}.x * {columns // 8}, {rows // 8}, {columns // 8}]::BIGINT[]"
    return f"""{', '.join(parts)},
    o{n} AS (SELECT c.y, c.x, c.cost AS c0, k.cost AS c1, a.cost + b.cost AS c2, d.cost + e.cost AS c3, [{leaf('c', n, n)}] AS l0, k.leaves AS l1,
        [{leaf('a', half, n)}, {leaf('b', half, n)}] AS l2, [{leaf('d', n, half)}, {leaf('e', n, half)}] AS l3
        FROM c{n} c JOIN (SELECT y // 2 AS y, x // 2 AS x, sum(cost) AS cost, flatten(list(leaves)) AS leaves FROM l{half} GROUP BY 1, 2 HAVING count(*) = 4) k ON k.y = c.y AND k.x = c.x
        JOIN t{n} a ON a.y = 2 * c.y AND a.x = c.x JOIN t{n} b ON b.y = 2 * c.y + 1 AND b.x = c.x JOIN s{n} d ON d.y = c.y AND d.x = 2 * c.x JOIN s{n} e ON e.y = c.y AND e.x = 2 * c.x + 1),
    l{n} AS (SELECT y, x, CASE WHEN c0 <= 1.25 THEN c0 ELSE least(c0, c1, c2, c3) END AS cost,
        CASE WHEN c0 <= 1.25 OR c0 <= least(c1, c2, c3) THEN l0 WHEN c1 <= least(c2, c3) THEN l1 WHEN c2 <= c3 THEN l2 ELSE l3 END AS leaves FROM o{n})"""


@_query(f"""WITH {_RASTER}, {_SCALES}, {_tried_sql()}, {', '.join(_level_sql(n) for n in (16, 32, 64))}
    SELECT y AS tile_y, x AS tile_x, round(cost, 6) AS cost, leaf[1] AS strategy, leaf[2] AS y, leaf[3] AS x, leaf[4] AS h, leaf[5] AS w FROM (SELECT y, x, cost, unnest(leaves) AS leaf FROM l64)""")
def transform_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search_tiles(rasters.embedding_raster(spark, sf_dir), scale=_SCALE)
    return out.select(F.col("y").alias("tile_y"), F.col("x").alias("tile_x"), F.round("cost", 6).alias("cost"), F.explode("leaves").alias("l")).select("tile_y", "tile_x", "cost", "l.*")


@_query(f"""{_RESIDUALS.replace('WITH ', 'WITH RECURSIVE ', 1)}, hist AS (SELECT x AS column_, token, count(*) AS n FROM tok GROUP BY ALL),
    m AS (SELECT column_, list_sort(list(n)) AS ws, 0::BIGINT AS bits, count(*) AS tokens FROM hist GROUP BY column_
          UNION ALL SELECT column_, list_sort(list_append(ws[3:], ws[1] + ws[2])), bits + ws[1] + ws[2], tokens FROM m WHERE len(ws) > 1)
    SELECT column_, tokens, bits, 32768::BIGINT AS kraft, true AS fits FROM m WHERE len(ws) = 1""")
def bounded_code_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What prefix codes of at most 15 bits cost for each column of the raster; merging the least weights costs their sum."""
    tokens = neighbours.residual_tokens(rasters.embedding_raster(spark, sf_dir)).withColumn("column_", F.col("x"))
    lengths = codelengths.code_lengths_bounded(entropy.histogram(tokens, "column_"), "column_")
    kraft = F.sum(F.pow(F.lit(2.0), 15 - F.col("len")).cast("long"))
    return lengths.groupBy("column_").agg(F.count("*").alias("tokens"), F.sum(F.col("n") * F.col("len")).alias("bits"), kraft.alias("kraft"), (F.max("len") <= 15).alias("fits"))


#: Bands of the weights by channel.
_BANDS = {0: [30.0, 0.8, 0.6, 0.9], 1: [12.0, 0.7, 0.5, 0.8, 0.9], 2: [20.0, 0.5, 0.7]}


def _weights_sql(rows: int, columns: int, strategy: int) -> str:
    """Rows (strategy, channel, v, u, weight) of a shape, whose longer axis lies across in the table of weights."""
    lo, hi = min(rows, columns), max(rows, columns)
    y, x = ("u", "v") if rows > columns else ("v", "u")
    out = []
    for channel, bands in _BANDS.items():
        n = len(bands) - 1
        values = ", ".join(f"({' * '.join(f'{b}::DOUBLE' for b in bands[: k + 1])})" for k in range(n + 1))
        pos = f"greatest(0, least({n}, sqrt(pow({y} / {lo - 1}.0, 2) + pow({x} / {hi - 1}.0, 2)) / sqrt(2.0) * {n}))"
        out.append(f"""SELECT {strategy} AS strategy, {channel} AS channel, v, u, b[k + 1] * pow(b[k + 2] / b[k + 1], pos - k) AS weight
            FROM (SELECT *, [{values}] AS b, least({n - 1}, floor(pos))::INTEGER AS k FROM (SELECT v, u, {pos} AS pos FROM range({rows}) i(v), range({columns}) j(u)))""")
    return " UNION ALL ".join(out)


_ROUTED = {0: (8, 8), 4: (16, 16), 6: (16, 8), 7: (8, 16)}
_RGB = "rgb AS (SELECT vec_id AS y, x, " + ", ".join(f"floor((embedding[3 * x + {k + 1}]::DOUBLE + 1.0) * 127.5)::BIGINT AS {c}" for k, c in enumerate("rgb")) + " FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 3)) AS x FROM embeddings))"


@_query(f"""WITH {_RGB}, {_SCALES}, px AS (SELECT y, x, 0 AS channel, r AS v FROM rgb UNION ALL SELECT y, x, 1, g FROM rgb UNION ALL SELECT y, x, 2, b FROM rgb),
    blocks AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 7 END AS strategy, CASE WHEN kind IN (1, 2) THEN 2 ELSE 1 END AS h, CASE WHEN kind IN (1, 3) THEN 2 ELSE 1 END AS w, 1 + "by" % 5 AS quantisation
        FROM (SELECT DISTINCT y // 8 AS "by", x // 8 AS bx, (y // 16) % 4 AS kind FROM rgb WHERE x // 16 * 16 + 16 <= (SELECT max(x) + 1 FROM rgb) AND y // 16 * 16 + 16 <= (SELECT max(y) + 1 FROM rgb))
        WHERE NOT (kind IN (1, 2) AND "by" % 2 = 1) AND NOT (kind IN (1, 3) AND bx % 2 = 1)),
    weights AS ({' UNION ALL '.join(_weights_sql(r, c, k) for k, (r, c) in _ROUTED.items())}),
    q AS (SELECT blocks.*, channel, px.y - 8 * "by" AS v, px.x - 8 * bx AS u, px.v % 7 - 3 AS q, px.v AS s FROM blocks JOIN px ON px.y // 8 BETWEEN "by" AND "by" + h - 1 AND px.x // 8 BETWEEN bx AND bx + w - 1),
    d AS (SELECT q.*, CASE WHEN q = 0 THEN 0 WHEN abs(q) = 1 THEN q * (1 - CASE channel WHEN 0 THEN 0.05465007330715401 WHEN 1 THEN 0.07005449891748593 ELSE 0.049935103337343655 END) ELSE q - 0.145 / q END * 40 / quantisation / weight AS coef
        FROM q JOIN weights USING (strategy, channel, v, u) WHERE NOT (v < h AND u < w)),
    ac AS (SELECT d."by", d.bx, strategy, h, w, channel, v, u, d.coef + CASE channel WHEN 1 THEN 0 ELSE l.coef * (CASE channel WHEN 0 THEN 0.25 ELSE 1 END * (1 + ((d."by" + v // 8) // 8 + (d.bx + u // 8) // 8) % 3)) END AS coef
        FROM d JOIN (SELECT "by", bx, v, u, coef FROM d WHERE channel = 1) l USING ("by", bx, v, u)),
    cells AS (SELECT "by", bx, strategy, h, w, channel, v // 8 AS cy, u // 8 AS cx, s / 10.0::DOUBLE AS cell FROM q WHERE v % 8 = 0 AND u % 8 = 0),
    low AS (SELECT "by", bx, strategy, h, w, channel, a.v, b.u, sum(cell * cos((cy + 0.5) * a.v * pi() / h) * cos((cx + 0.5) * b.u * pi() / w)) * CASE WHEN a.v = 0 THEN 1 ELSE sqrt(2) END * CASE WHEN b.u = 0 THEN 1 ELSE sqrt(2) END / (h * w) * any_value(sy.s * sx.s) AS coef
        FROM cells, range(2) a(v), range(2) b(u), scales sy, scales sx WHERE a.v < h AND b.u < w AND sy.c = h AND sy.k = a.v AND sx.c = w AND sx.k = b.u GROUP BY "by", bx, strategy, h, w, channel, a.v, b.u),
    co AS (SELECT * FROM ac UNION ALL SELECT * FROM low),
    across AS (SELECT "by", bx, h, w, channel, v, x, sum(coef * CASE WHEN u = 0 THEN 1 ELSE sqrt(2) END * cos((2 * x + 1) * u * pi() / (16 * w))) AS s FROM co, range(16) r(x) WHERE x < 8 * w GROUP BY ALL),
    out AS (SELECT "by", bx, channel, y, x, sum(s * CASE WHEN v = 0 THEN 1 ELSE sqrt(2) END * cos((2 * y + 1) * v * pi() / (16 * h))) AS s FROM across, range(16) r(y) WHERE y < 8 * h GROUP BY ALL)
    SELECT channel, "by" * 8 + y AS y, bx * 8 + x AS x, round(s, 6) + 0.0 AS v FROM out""")
def reconstructed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four strategies in turn, their coefficients and cells taken from the pixels of the embeddings."""
    pixels = rasters.embedding_pixels(spark, sf_dir)
    px = pixels.select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("channel", "s"))
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))  # a row an image
    at = pixels.select("image_id", F.floor(F.col("y") / 8).alias("y"), F.floor(F.col("x") / 8).alias("x")).distinct().join(size, "image_id")
    at = at.where((F.floor(F.col("y") / 2) * 16 + 16 <= F.col("height")) & (F.floor(F.col("x") / 2) * 16 + 16 <= F.col("width")))
    kind = F.floor(F.col("y") / 2) % 4
    blocks = at.withColumn("kind", kind).where(~(F.col("kind").isin(1, 2) & (F.col("y") % 2 == 1)) & ~(F.col("kind").isin(1, 3) & (F.col("x") % 2 == 1)))
    strategy = F.get(F.array(*map(F.lit, _ROUTED)), F.col("kind").cast("int")).cast("long")
    blocks = blocks.select("image_id", (F.col("y") * 65536 + F.col("x")).alias("block"), strategy.alias("strategy"), "y", "x", (1 + F.col("y") % 5).alias("quantisation"), "kind")
    cell_y, cell_x, kind = F.floor(F.col("y") / 8), F.floor(F.col("x") / 8), F.floor(F.col("y") / 16) % 4
    by, bx = F.when(kind.isin(1, 2), cell_y - cell_y % 2).otherwise(cell_y), F.when(kind.isin(1, 3), cell_x - cell_x % 2).otherwise(cell_x)
    coefs = px.select("image_id", "channel", (by * 65536 + bx).alias("block"), (F.col("y") - by * 8).cast("int").alias("v"), (F.col("x") - bx * 8).cast("int").alias("u"), (F.col("s") % 7 - 3).alias("q"))
    cells = px.where("y % 8 = 0 AND x % 8 = 0").select("image_id", "channel", cell_y.alias("y"), cell_x.alias("x"), (F.col("s") / 10.0).alias("v"))
    f = 1 + (F.col("ty") + F.col("tx")) % 3
    tiles = blocks.select("image_id", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx")).distinct().select("image_id", "ty", "tx", (0.25 * f).alias("fx"), f.cast("double").alias("fb"))
    weights = reconstruction.strategy_weights(spark, list(_ROUTED), _BANDS)
    out = reconstruction.reconstruct(coefs, blocks.drop("kind"), cells, weights, tiles, 40.0)
    return out.select("channel", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@_query(f"""WITH {_RGB}, size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM rgb),
    px AS (SELECT 0 AS channel, y, x, r AS v FROM rgb UNION ALL SELECT 1, y, x, g FROM rgb, size WHERE x < w // 2 AND y < h // 2 UNION ALL SELECT 2, y, x, b FROM rgb, size WHERE x < w // 2 AND y < h // 2),
    q AS (SELECT channel, y // 8 AS "by", x // 8 AS bx, y % 8 AS v, x % 8 AS u, CASE WHEN y % 8 + x % 8 = 0 THEN (v - 128) * 6 ELSE (v % 5 - 2) * (1 + y % 8 + x % 8) END / 8.0::DOUBLE AS coef FROM px QUALIFY count(*) OVER (PARTITION BY channel, y // 8, x // 8) = 64),
    wave AS (SELECT k, i, CASE WHEN k = 0 THEN 1 ELSE sqrt(2) END * cos((2 * i + 1) * k * pi() / 16) AS w FROM range(8) a(k), range(8) b(i)),
    across AS (SELECT channel, "by", bx, v, i AS x, sum(coef * w) AS s FROM q JOIN wave ON k = u GROUP BY ALL),
    plane AS (SELECT channel, "by" * 8 + i AS y, bx * 8 + x AS x, greatest(0, least(255, round(round(sum(s * w), 6)) + 128)) AS p FROM across JOIN wave ON k = v GROUP BY ALL),
    full_ AS (SELECT l.y, l.x, l.p AS p0, c.p AS p1, d.p AS p2 FROM plane l JOIN plane c ON c.channel = 1 AND c.y = l.y // 2 AND c.x = l.x // 2 JOIN plane d ON d.channel = 2 AND d.y = l.y // 2 AND d.x = l.x // 2 WHERE l.channel = 0)
    SELECT y, x, greatest(0, least(255, round(p0 + 1.402::DOUBLE * (p2 - 128))))::BIGINT AS r, greatest(0, least(255, round(p0 - 0.344136::DOUBLE * (p1 - 128) - 0.714136::DOUBLE * (p2 - 128))))::BIGINT AS g,
        greatest(0, least(255, round(p0 + 1.772::DOUBLE * (p1 - 128))))::BIGINT AS b FROM full_""")
def jpeg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients taken from the pixels of the embeddings, chroma at half the size each way."""
    image = rasters.embedding_pixels(spark, sf_dir)
    size = image.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
    px = image.select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("channel", "s"))
    px = px.where((F.col("channel") == 0) | ((F.col("x") < (size.w or 0) // 2) & (F.col("y") < (size.h or 0) // 2)))
    v, u = F.col("y") % 8, F.col("x") % 8
    q = F.when(v + u == 0, F.col("s") - 128).otherwise(F.col("s") % 5 - 2)
    coefs = px.select("image_id", "channel", F.floor(F.col("y") / 8).alias("by"), F.floor(F.col("x") / 8).alias("bx"), v.cast("int").alias("v"), u.cast("int").alias("u"), q.alias("q"))
    steps = spark.createDataFrame([(c, a, b, 6 if a + b == 0 else 1 + a + b) for c in range(3) for a in range(8) for b in range(8)], "channel int, v int, u int, step int")
    factors = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 2, 2)], "channel int, across int, down int")
    return jpeg.pixels(coefs, steps, factors, size.w or 0, size.h or 0).select("y", "x", "r", "g", "b")
