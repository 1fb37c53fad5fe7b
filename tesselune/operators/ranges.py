"""Cuts by bands of lines and by ranges of an order, so that no window needs a whole image, key or table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a band, and rows of a key that one task sorts; keys of more are cut into ranges of their order.
LINES, ROWS = 64, 1 << 20


def banded(samples: DataFrame, keys: tuple[str, ...], above: int = 0, below: int = 0, lines: int = LINES) -> DataFrame:
    """Adds _band, dealt out by keys and band, and _own: whether a row is the band's own.

    Beside its own ``lines`` lines a band has ``above`` lines before and ``below`` after them, so windows by keys
    and band see the neighbours of its own rows. Lines (y) of a raster follow each other without gaps.
    """
    at = [F.floor((F.col("y") + d) / lines) for d in sorted({above, 0, -below})]
    out = samples.withColumn("_band", F.explode(F.array_distinct(F.array(*at))))
    return out.withColumn("_own", F.col("_band") == F.floor(F.col("y") / lines)).repartition(*keys, "_band")


def cut(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """Adds _part, which grows with the number ``order``: about equal ranges of it, by bounds that come to the driver."""
    bounds = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or [] if parts > 1 else []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.expr("CAST(array() AS array<bigint>)")
    return rows.withColumn("_part", F.size(F.filter(bounds, lambda b: b < F.col(order))))


def _null_safe(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]


def before(rows: DataFrame, keys: tuple[str, ...], order: str, value: Column, most: int = ROWS) -> DataFrame:
    """Adds _before: the sum of the values of a key's rows that come earlier in the order, a number.

    Rows are counted by key first. Keys of up to ``most`` rows are summed by a window of their own; those of more are cut into
    ranges of their order of about so many rows, at most 1,000, whose sums are added up apart.
    """
    rows = rows.withColumn("_value", value)
    sum_before = F.coalesce(F.sum("_value").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = [*[c for c in rows.columns if c != "_value"], "_before"]
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    keys_n, rows_n = crowded.agg(F.count("*"), F.sum("_n")).first()
    if not keys_n:
        return rows.withColumn("_before", sum_before).select(own)
    names = [F.col(f"l.{c}") for c in rows.columns]
    hot = rows.alias("l").join(crowded.alias("r"), _null_safe(keys)).select(names) if keys else rows
    parts = cut(hot, order, min(1000, -(-rows_n // most)))
    local = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total"))
    totals = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    both = parts.alias("l").join(totals.alias("r"), _null_safe((*keys, "_part")))
    both = both.select(*[F.col(f"l.{c}") for c in own if c != "_before"], (F.col("l._before") + F.col("r._earlier")).alias("_before"))
    if not keys:
        return both
    cold = rows.alias("l").join(crowded.alias("r"), _null_safe(keys), "left_anti")
    return both.unionByName(cold.withColumn("_before", sum_before).select(own))
