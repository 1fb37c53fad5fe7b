"""Registered queries of predictors that need the samples before, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselune.operators import entropy, neighbours, recurrences, weighted
from tesselune.operators.weighted import Leaf
from tesselune.plans.queries import _FREQ, _GRADIENT, _PREDICTORS, _RASTER, _near, _query
from tesselune.sources import rasters

#: A tree whose leaves predict in ways of their own, over w - n, n, the gradient's size and the line in the tile.
MIXED = (8, 3, (6, 130, Leaf(5), Leaf(1, 2)), (2, 7, (9, 120, Leaf(12), Leaf(4)), (12, -2, Leaf(13, -1), (3, 0, Leaf(9), Leaf(2)))))
_MIXED_SQL = f"""CASE WHEN w - n > 3 THEN CASE WHEN n > 130 THEN 0 ELSE 1 END
    WHEN y % 16 > 7 THEN CASE WHEN w + n - nw > 120 THEN 2 ELSE 3 END
    WHEN n - ne > -2 THEN 4 WHEN x % 16 > 0 THEN 5 ELSE 6 END"""
_GUESS_SQL = f"""CASE leaf WHEN 0 THEN {_GRADIENT} WHEN 1 THEN w + 2 WHEN 2 THEN {_PREDICTORS[12]} WHEN 3 THEN {_PREDICTORS[4]} WHEN 4 THEN ({_PREDICTORS[13]}) - 1 WHEN 5 THEN ww ELSE n END"""
_TILES = f"WITH RECURSIVE {_RASTER}, tiles AS (SELECT *, y // 16 AS gy, x // 16 AS gx FROM raster), {_near('tiles', 'gy, gx')}"


@_query(f"{_TILES}, l AS (SELECT *, {_MIXED_SQL} AS leaf FROM near) SELECT y, x, leaf::BIGINT AS leaf, v - ({_GUESS_SQL}) AS residual FROM l")
def mixed_tree_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.tree_residuals(rasters.embedding_raster(spark, sf_dir), MIXED, 16).select("y", "x", "leaf", "residual")


@_query(f"WITH {_RASTER} SELECT y, x, v FROM raster")
def mixed_tree_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals by expressions over whole neighbourhoods, and samples made one after the other."""
    near = neighbours.neighbours(neighbours.tiled(rasters.embedding_raster(spark, sf_dir), 16), ("image_id", "channel", "gy", "gx"))
    near = near.withColumns({"ty": F.col("y") % 16, "tx": F.col("x") % 16})
    props = neighbours.properties(near) | {2: F.col("ty"), 3: F.col("tx")}

    def guess(tree: tuple | Leaf) -> F.Column:
        if isinstance(tree, Leaf):
            return neighbours.predictor(tree.predictor) + tree.offset
        return F.when(props[tree[0]] > tree[1], guess(tree[2])).otherwise(guess(tree[3]))

    residuals = near.select("image_id", "channel", "y", "x", (F.col("v") - guess(MIXED)).alias("residual"))
    return weighted.tree_samples(residuals, MIXED, 16).select("y", "x", "v")


def _each(text: str) -> str:
    """The text for each of the four guesses; # stands for its number."""
    return ", ".join(text.replace("#", str(k)).replace("$", str((13, 12, 12, 12)[k])) for k in range(4))


_LENGTH = "(CASE WHEN {v} > 0 THEN floor(log2({v}))::BIGINT + 1 ELSE 0 END)"
#: The predictor, sample after sample of a tile; lists hold what was wrong so far, in order of samples.
_CORRECTING = f"""{_TILES},
    p AS (SELECT gy, gx, y, x, y % 16 AS ty, x % 16 AS tx, (y % 16) * 16 + x % 16 AS i, v, 8 * v AS v8, 8 * w AS w, 8 * n AS n, 8 * nw AS nw, 8 * ne AS ne, 8 * nn AS nn FROM near),
    s AS (
        SELECT DISTINCT gy, gx, -1::BIGINT AS i, []::BIGINT[] AS wrong, {_each('[]::BIGINT[] AS e#')}, 0::BIGINT AS pred, 0::BIGINT AS prop FROM p
        UNION ALL
        SELECT gy, gx, i, list_append(wrong, pred - v8), {_each('list_append(e#, (abs(g# - v8) + 3) >> 3)')}, pred, prop FROM (
        SELECT *, CASE WHEN xor(tn, tw) | xor(tn, tnw) <= 0 THEN greatest(least(w, n, ne), least(last, greatest(w, n, ne))) ELSE last END AS pred FROM (
        SELECT *, (((whole >> 1) - 1 + a0 * g0 + a1 * g1 + a2 * g2 + a3 * g3) * (16777216 // whole)) >> 24 AS last FROM (
        SELECT *, a0 + a1 + a2 + a3 AS whole FROM (
        SELECT *, {_each('b# >> scale AS a#')} FROM (
        SELECT *, {_LENGTH.format(v='(b0 + b1 + b2 + b3)')} - 5 AS scale FROM (
        SELECT *, {_each('4 + (($ * (16777216 // ((s# >> h#) + 1))) >> h#) AS b#')} FROM (
        SELECT *, {_each('greatest(0, ' + _LENGTH.format(v='(s# + 1)') + ' - 6) AS h#')} FROM (
        SELECT *, {_each('u# + (CASE WHEN tx < 15 THEN CASE WHEN ty > 0 THEN e#[i - 14] ELSE 0 END ELSE u# END) + (CASE WHEN tx > 0 THEN CASE WHEN ty > 0 THEN e#[i - 16] ELSE 0 END + CASE WHEN tx > 1 THEN e#[i - 1] ELSE 0 END ELSE u# END) AS s#')},
               w + ne - n AS g0, n - (((tn + tw + tne) * 16) >> 5) AS g1, w - (((tn + tw + tnw) * 10) >> 5) AS g2, n - ((tnw * 7 + tn * 7 + tne * 7) >> 5) AS g3,
               CASE WHEN abs(tne) > greatest(abs(tw), abs(tn), abs(tnw)) THEN tne WHEN abs(tnw) > greatest(abs(tw), abs(tn)) THEN tnw WHEN abs(tn) > abs(tw) THEN tn ELSE tw END AS prop FROM (
        SELECT *, CASE WHEN tx > 0 THEN CASE WHEN ty > 0 THEN wrong[i - 16] ELSE 0 END ELSE tn END AS tnw, CASE WHEN tx < 15 THEN CASE WHEN ty > 0 THEN wrong[i - 14] ELSE 0 END ELSE tn END AS tne FROM (
        SELECT p.*, wrong, e0, e1, e2, e3, CASE WHEN ty > 0 THEN wrong[p.i - 15] ELSE 0 END AS tn, CASE WHEN tx > 0 THEN wrong[p.i] ELSE 0 END AS tw,
               {_each('CASE WHEN ty > 0 THEN e#[p.i - 15] ELSE 0 END + CASE WHEN tx > 0 THEN e#[p.i] ELSE 0 END AS u#')}
        FROM s JOIN p ON p.gy = s.gy AND p.gx = s.gx AND p.i = s.i + 1)))))))))))"""


@_query(f"{_CORRECTING} SELECT p.y, p.x, v - ((s.pred + 3) >> 3) AS residual, prop AS error FROM s JOIN p USING (gy, gx, i)")
def weighted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the self-correcting predictor and its error property."""
    tree = (15, 0, Leaf(6), Leaf(6))
    return weighted.tree_residuals(rasters.embedding_raster(spark, sf_dir), tree, 16).select("y", "x", "residual", "error")


@_query(f"""{_CORRECTING}, l AS (SELECT p.y, p.x, s.pred, s.prop, near.v, near.w, near.n, near.nw FROM s JOIN p USING (gy, gx, i) JOIN near ON near.y = p.y AND near.x = p.x)
    SELECT y, x, CASE WHEN prop > 40 THEN 0 WHEN prop > -40 THEN 1 ELSE 2 END::BIGINT AS leaf, v - CASE WHEN prop > 40 THEN {_GRADIENT} WHEN prop > -40 THEN (pred + 3) >> 3 ELSE n END AS residual FROM l""")
def error_tree_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over the self-correcting predictor's own error; the predictor goes on in leaves that do not use it."""
    tree = (15, 40, Leaf(5), (15, -40, Leaf(6), Leaf(2)))
    return weighted.tree_residuals(rasters.embedding_raster(spark, sf_dir), tree, 16).select("y", "x", "leaf", "residual")


def _squeezed_sql(line: str, place: str) -> str:
    return f"""WITH {_RASTER}, pr AS (SELECT {line} AS line, {place} // 2 AS k, max(v) FILTER ({place} % 2 = 0) AS v0, max(v) FILTER ({place} % 2 = 1) AS v1 FROM raster GROUP BY ALL),
    m AS (SELECT *, CASE WHEN v1 IS NULL THEN v0 ELSE (v0 + v1 + (v0 > v1)::BIGINT) >> 1 END AS a FROM pr),
    t AS (SELECT *, coalesce(lag(v1) OVER w, a) AS b, coalesce(lead(a) OVER w, a) AS n FROM m WINDOW w AS (PARTITION BY line ORDER BY k)),
    d AS (SELECT *, trunc((4 * b - 3 * n - a + 6) / 12.0)::BIGINT AS f0, trunc((4 * b - 3 * n - a - 6) / 12.0)::BIGINT AS r0 FROM t),
    d1 AS (SELECT *, CASE WHEN f0 - abs(f0 % 2) > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE f0 END AS f1, CASE WHEN r0 + abs(r0 % 2) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE r0 END AS r1 FROM d),
    d2 AS (SELECT *, CASE WHEN f1 + abs(f1 % 2) > 2 * (a - n) THEN 2 * (a - n) ELSE f1 END AS f2, CASE WHEN r1 - abs(r1 % 2) < 2 * (a - n) THEN 2 * (a - n) ELSE r1 END AS r2 FROM d1)
    SELECT line, k, a AS low, v0 - v1 - CASE WHEN b >= a AND a >= n THEN f2 WHEN b <= a AND a <= n THEN r2 ELSE 0 END AS high FROM d2"""


def _squeezed(spark: SparkSession, sf_dir: str, down: bool) -> DataFrame:
    out = recurrences.squeeze(rasters.embedding_raster(spark, sf_dir), down)
    out = out.select(F.col("y").alias("line"), "high", F.posexplode("low").alias("k", "low"))
    return out.select("line", F.col("k").cast("long").alias("k"), "low", F.get("high", F.col("k")).cast("long").alias("high"))


@_query(_squeezed_sql("y", "x"))
def squeezed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squeezed(spark, sf_dir, False)


@_query(_squeezed_sql("x", "y"))
def squeezed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squeezed(spark, sf_dir, True)


@_query(f"WITH {_RASTER} SELECT y, x, v FROM raster")
def squeeze_columns_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrences.unsqueeze_pairs(recurrences.squeeze_pairs(rasters.embedding_raster(spark, sf_dir), True), True).select("y", "x", "v")


@_query(f"""{_FREQ}, t AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY x) - 1 AS place, freq, cum FROM tok JOIN cums USING (token)),
    c AS (SELECT y, max(place) + 1 AS rest, {0x130000}::BIGINT AS st, []::BIGINT[] AS w FROM t GROUP BY y
          UNION ALL
          SELECT y, place, ((x // freq) << 12) + x % freq + cum, CASE WHEN refill THEN list_append(w, st & 65535) ELSE w END
          FROM (SELECT c.y, c.w, c.st, t.place, freq, cum, (st >> 20) >= freq AS refill, CASE WHEN (st >> 20) >= freq THEN st >> 16 ELSE st END AS x FROM c JOIN t ON t.y = c.y AND t.place = c.rest - 1))
    SELECT y, array_to_string(list_reverse(list_concat(w, [st & 65535, st >> 16])), ',') AS words FROM c WHERE rest = 0""")
def range_coded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each line's tokens, as the range coder writes them."""
    tokens = neighbours.residual_tokens(rasters.embedding_raster(spark, sf_dir))
    table = entropy.cumulative(entropy.frequencies(entropy.histogram(tokens)))
    return recurrences.rans_sections(tokens, table, "y", "x").select("y", F.array_join(F.col("words").cast("array<string>"), ",").alias("words"))
