"""Registered queries of learned trees and thresholds, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselune.operators import neighbours, trees
from tesselune.plans.queries import _GRADIENT, _RASTER, _TOKEN, _ZIGZAG, _near, _query
from tesselune.sources import rasters

#: Properties that the tree may ask: sizes of n and w, the gradient, w - nw, n - ne.
PROPS = ("p4", "p5", "p9", "p10", "p12")

_ROWS = f"""{_RASTER}, {_near()},
    res AS (SELECT y, x, abs(n) AS p4, abs(w) AS p5, w + n - nw AS p9, w - nw AS p10, n - ne AS p12, {_ZIGZAG.format(r=f'(v - {_GRADIENT})')} AS u FROM near),
    tok AS (SELECT *, {_TOKEN} AS token FROM res),
    long AS ({' UNION ALL '.join(f"SELECT y, x, token, {k} AS rank, {p} AS value FROM tok" for k, p in enumerate(PROPS))})"""


def _cuts_sql(name: str, source: str, keys: str) -> str:
    """CTEs up to ``name``: (keys, threshold, bits, whole), by counting both sides of every threshold anew."""
    bits = lambda c: f"(coalesce(sum({c}) * log2(nullif(sum({c}), 0)), 0) - sum(CASE WHEN {c} > 1 THEN {c} * log2({c}) ELSE 0 END))"
    return f"""{name}_c AS (SELECT {keys}, value, token, count(*) AS n FROM {source} GROUP BY ALL),
    {name}_s AS (SELECT {keys}, t.value AS threshold, c.token, coalesce(sum(n) FILTER (c.value <= t.value), 0) AS lo, coalesce(sum(n) FILTER (c.value > t.value), 0) AS hi
        FROM (SELECT DISTINCT {keys}, value FROM {name}_c) t JOIN {name}_c c USING ({keys}) GROUP BY ALL),
    {name} AS (SELECT {keys}, threshold, round(round({bits('lo')}, 6) + round({bits('hi')}, 6), 6) AS bits, round({bits('(lo + hi)')}, 6) AS whole
        FROM {name}_s GROUP BY {keys}, threshold HAVING sum(hi) > 0)"""


def _best_sql(name: str, source: str) -> str:
    return f"""{_cuts_sql(f'{name}_k', source, 'leaf, rank')},
    {name} AS (SELECT leaf, rank, threshold, round(whole - bits, 6) AS gain FROM {name}_k QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY bits, rank, threshold) = 1)"""


_TREE3 = f"""WITH {_ROWS}, zero AS (SELECT *, 0 AS leaf FROM long), {_best_sql('root', 'zero')},
    sides AS (SELECT y, x, CASE WHEN value > threshold THEN 1 ELSE 2 END AS leaf FROM long JOIN root USING (rank)),
    both_ AS (SELECT long.*, sides.leaf FROM long JOIN sides USING (y, x)), {_best_sql('next', 'both_')},
    second AS (SELECT * FROM next WHERE gain > 32 ORDER BY gain DESC, leaf LIMIT 1),
    names AS (SELECT k, 'p' || p AS property FROM (VALUES (0, 4), (1, 5), (2, 9), (3, 10), (4, 12)) t(k, p))"""


@_query(f"""{_TREE3}
    SELECT 0::BIGINT AS node, property, threshold::BIGINT AS split, 1::BIGINT AS left_child, 2::BIGINT AS right_child, NULL::BIGINT AS leaf FROM root JOIN names ON k = rank
    UNION ALL SELECT leaf, property, threshold::BIGINT, 3, 4, NULL FROM second JOIN names ON k = rank
    UNION ALL SELECT 3 - leaf, NULL, NULL, NULL, NULL, 0 FROM second
    UNION ALL SELECT unnest([3, 4]), NULL, NULL, NULL, NULL, unnest([1, 2]) FROM second""")
def learned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _samples(spark, sf_dir)
    return trees.tree_table(spark, trees.learn_tree(rows, PROPS, max_leaves=3))


@_query(f"""{_TREE3},
    parted AS (SELECT long.y, long.x, long.value > second.threshold AS up FROM long JOIN second USING (rank)),
    leaves AS (SELECT y, x, token, CASE WHEN sides.leaf <> second.leaf THEN 0 WHEN up THEN 1 ELSE 2 END AS leaf FROM tok JOIN sides USING (y, x) JOIN parted USING (y, x), second)
    SELECT leaf::BIGINT AS leaf, token, count(*) AS n FROM leaves GROUP BY ALL""")
def learned_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _samples(spark, sf_dir)
    tree = trees.learn_tree(rows, PROPS, max_leaves=3)
    return rows.groupBy(trees.contexts(tree).alias("leaf"), "token").agg(F.count("*").alias("n"))


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    near = neighbours.residual_tokens(rasters.embedding_raster(spark, sf_dir))
    return near.select(*[c.alias(f"p{k}") for k, c in neighbours.properties(near).items()], "token"), near


def _range_sql(thresholds: str) -> str:
    return f"(SELECT value, token, (SELECT count(*) FROM {thresholds} t WHERE t.threshold < r.value) AS range FROM r)"


def _level_sql(k: int) -> str:
    """CTEs up to t{k}, the thresholds of k levels."""
    source = "(SELECT value, token, 0 AS range FROM r)" if k == 1 else _range_sql(f"t{k - 1}")
    first = "" if k == 1 else f"SELECT threshold FROM t{k - 1} UNION ALL "
    return f"""{_cuts_sql(f'l{k}', source, 'range')},
    t{k} AS ({first}SELECT threshold FROM (SELECT threshold FROM l{k} QUALIFY row_number() OVER (PARTITION BY range ORDER BY bits, threshold) = 1))"""


@_query(f"""WITH {_ROWS}, r AS (SELECT p10 AS value, token FROM tok), {', '.join(_level_sql(k) for k in (1, 2, 3))},
    sets AS ({' UNION ALL '.join(f"SELECT {2**k - 1}::BIGINT AS cuts, threshold FROM t{k}" for k in (1, 2, 3))})
    SELECT cuts, row_number() OVER (PARTITION BY cuts ORDER BY threshold) AS k, threshold::BIGINT AS threshold FROM sets""")
def learned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _samples(spark, sf_dir)
    sets = trees.learned_thresholds(rows, "p10")
    return spark.createDataFrame([(len(s), k + 1, t) for s in sets for k, t in enumerate(s)], "cuts long, k long, threshold long")
