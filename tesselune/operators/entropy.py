"""Histograms, frequencies, code lengths and costs of token streams, as aggregations and small windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselune.functions import codes
from tesselune.functions.codes import bit_length
from tesselune.operators.ranges import ROWS, before

#: Frequencies of a table add up to this.
TABLE = 4096


def histogram(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, n)."""
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def frequencies(hist: DataFrame, *keys: str) -> DataFrame:
    """Adds freq: n scaled to sum to ``TABLE``, rounded down and 1 at least; what is over or short is taken one by
    one from, or given to, the token with the largest freq, the first such. Alphabets must fit the table."""
    by = keys or ("_all",)
    rows = hist if keys else hist.withColumn("_all", F.lit(0))
    rows = rows.withColumn("freq", F.greatest(F.lit(1), F.expr(f"n * {TABLE} div sum(n) OVER (PARTITION BY {', '.join(by)})")).cast("long"))
    one = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("token", "n", "freq"))).alias("t"))
    left = F.expr(f"{TABLE}L - aggregate(t, 0L, (a, e) -> a + e.freq)")
    one = one.withColumn("left", left).withColumn("f", F.expr("transform(t, e -> e.freq)"))
    fixed = F.expr("""
        IF(left = 0, f, aggregate(sequence(1L, abs(left)), f, (a, i) ->
          transform(a, (x, k) -> IF(k = array_position(a, array_max(a)) - 1, x + CAST(signum(left) AS bigint), x))))""")
    out = one.withColumn("f", fixed).select(*by, F.explode(F.arrays_zip("t", "f")).alias("e"))
    return out.select(*keys, "e.t.token", "e.t.n", F.col("e.f").alias("freq"))


def cumulative(freqs: DataFrame, *keys: str) -> DataFrame:
    """Adds cum, the frequencies before a token's."""
    order = Window.partitionBy(*keys).orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    return freqs.withColumn("cum", F.coalesce(F.sum("freq").over(order), F.lit(0)))


def slots(cums: DataFrame) -> DataFrame:
    """(slot, token) of each slot of the table: a token owns freq slots from cum on."""
    return cums.select(F.explode(F.sequence("cum", F.col("cum") + F.col("freq") - 1)).alias("slot"), "token")


def code_lengths(hist: DataFrame, *keys: str) -> DataFrame:
    """Adds len by rank: one token needs no bits, two one each; of n the most frequent 2**L - n have L - 1 bits,
    the others L, for the least L with 2**L >= n. Ties go to the smaller token."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "token"))
    count = F.count("*").over(Window.partitionBy(*keys))
    bits = F.ceil(F.log2(count)).cast("int")
    length = F.when(count == 1, 0).when(count == 2, 1).when(rank <= F.pow(F.lit(2.0), bits) - count, bits - 1).otherwise(bits)
    return hist.withColumn("len", length.cast("int"))


def canonical_codes(lengths: DataFrame, longest: int = 15) -> DataFrame:
    """Adds code: codes count up in order of (len, token), as sums of 2**(longest - len) shifted back."""
    weight = F.pow(F.lit(2.0), longest - F.col("len")).cast("long")
    before = Window.orderBy("len", "token").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(weight).over(before), F.lit(0))
    return lengths.withColumn("code", F.floor(start / weight).cast("long"))


def kraft(lengths: DataFrame, longest: int = 15) -> DataFrame:
    """(tokens, kraft): 2**longest exactly if the lengths make a complete code."""
    return lengths.agg(F.count("*").alias("tokens"), F.sum(F.pow(F.lit(2.0), longest - F.col("len")).cast("long")).alias("kraft"))


def code_cost(lengths: DataFrame, *keys: str) -> DataFrame:
    """(keys, bits): what the tokens cost with their code lengths."""
    return lengths.groupBy(*keys).agg(F.sum(F.col("n") * F.col("len")).alias("bits"))


def entropy_bits(hist: DataFrame, *keys: str) -> DataFrame:
    """(keys, bits): total * log2(total) less the sum of n * log2(n)."""
    total = F.sum("n")
    return hist.groupBy(*keys).agg((total * F.log2(total) - F.sum(F.col("n") * F.log2("n"))).alias("bits"))


def bit_length_cost(residuals: Column) -> Column:
    """Sum of the bits of zigzagged residuals: the stand-in for a plane's cost."""
    return F.sum(bit_length(residuals))


def flat(hist: DataFrame, total: int = TABLE) -> DataFrame:
    """(tokens, is_flat): whether freq is total / n for each, one more for the first total % n tokens."""
    order, all_ = Window.orderBy("token"), Window.partitionBy()
    n = F.count("*").over(all_)
    want = F.floor(F.lit(total) / n) + F.when(F.row_number().over(order) <= F.lit(total) % n, 1).otherwise(0)
    return hist.withColumn("_same", F.col("freq") == want).agg(F.count("*").alias("tokens"), F.min("_same").alias("is_flat"))


def octiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, k, threshold) for k of 1 to 7: the value at place floor(n * k / 8) in order, ties kept.

    Equal values are counted first: windows hold a row for each value that a key has, not for each sample.
    """
    counts = values.groupBy(key, F.col(value).alias("threshold")).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(key).orderBy("threshold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.select(key, "threshold", "_c", F.sum("_c").over(up).alias("_end"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("_at", F.floor(F.col("_n") * F.col("k") / 8))
    return rows.where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))).select(key, "k", "threshold")


def uniform_subsample(rows: DataFrame, order: str, most: int, task_rows: int = ROWS) -> DataFrame:
    """The rows at places floor(i * n / most) of an order; all if there are no more than ``most``.

    The place is a global rank, so rows are ranked within ranges of ``order``, a number, and the ranges' counts
    added up.
    """
    out = before(rows, (), order, F.lit(1).cast("long"), task_rows).withColumnRenamed("_before", "_place")
    out = out.join(F.broadcast(rows.agg(F.count("*").alias("_n"))))  # one row
    # place = floor(i * n / most) for some i exactly if ceil(place * most / n) * n / most falls below place + 1
    i = F.expr(f"CAST(ceil(_place * {most} / _n) AS bigint)")
    hit = (F.col("_n") <= most) | ((i < most) & (F.expr(f"CAST(ceil(_place * {most} / _n) AS bigint) * _n div {most}") == F.col("_place")))
    return out.where(hit).drop("_n", "_place")


def best_split(tokens: DataFrame, key: str, prop: str) -> DataFrame:
    """(key, threshold, bits): where to cut a property so that the tokens on either side cost least by entropy.

    A side's bits are N log N less the sum of c log c of its tokens' counts; those sums are running sums of what
    each (property, token) changes, so all cuts cost one pass. The largest value is no cut; the smaller threshold
    wins ties; a key of one value gives no row. Bits are compared to six decimals.
    """
    counts = tokens.groupBy(key, F.col(prop).alias("threshold"), "token").agg(F.count("*").alias("n"))

    def weight(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0)

    up = Window.partitionBy(key, "token").orderBy("threshold")
    down = Window.partitionBy(key, "token").orderBy(F.col("threshold").desc())
    so_far = [F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for w in (up, down)]
    steps = counts.select(key, "threshold", "n", *[(weight(c) - weight(c - F.col("n"))).alias(a) for c, a in zip(so_far, ("l", "r"), strict=True)])
    at = steps.groupBy(key, "threshold").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    left = Window.partitionBy(key).orderBy("threshold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy(key).orderBy("threshold").rowsBetween(1, Window.unboundedFollowing)
    sides = at.select(key, "threshold", *[F.sum(c).over(w).alias(a) for c, w, a in (("n", left, "nl"), ("l", left, "sl"), ("n", right, "nr"), ("r", right, "sr"))]).where("nr IS NOT NULL")
    bits = F.round(weight(F.col("nl")) - F.col("sl") + weight(F.col("nr")) - F.col("sr"), 6)
    cuts = sides.select(key, "threshold", bits.alias("bits"))
    return cuts.groupBy(key).agg(F.min(F.struct("bits", "threshold")).alias("best")).select(key, "best.threshold", "best.bits")


def coarse_counts(freqs: DataFrame, shift: int, *keys: str, total: int = TABLE) -> DataFrame:
    """(keys, token, freq, kept, omitted) of frequencies (keys, token, freq) that add up to ``total``.

    kept is the next count below that the coarse form can tell; the first token of the greatest size in bits takes what is
    left of the total instead, and is the omitted one. A key for which nothing is left has no rows.
    """
    rows = freqs.withColumn("kept", codes.count_kept(F.col("freq"), shift))
    rows = rows.withColumn("_bits", codes.bit_length(F.col("kept")))
    by = Window.partitionBy(*keys)
    first = F.row_number().over(by.orderBy(F.desc("_bits"), "token")) == 1
    rows = rows.withColumn("omitted", first).withColumn("_left", F.lit(total) - F.sum(F.when(F.col("omitted"), 0).otherwise(F.col("kept"))).over(by))
    return rows.where("_left > 0").select(*keys, "token", "freq", F.when(F.col("omitted"), F.col("_left")).otherwise(F.col("kept")).cast("long").alias("kept"), "omitted")


def table_frequencies(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, n, freq) of whole alphabets: tokens of no count have frequency 0, the others as ``frequencies``."""
    used = frequencies(counts.where("n > 0"), *keys)
    return counts.join(used.drop("n"), [*keys, "token"], "left").select(*keys, "token", "n", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))
