"""Steps that need what they made before: folds over a line, a list or a section, parallel across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselune.functions.codes import smooth_tendency
from tesselune.session import ready

#: The state that a stream of symbols begins and ends with, and the table's bits.
STATE, TABLE_BITS = 0x130000, 12


def _lines(samples: DataFrame, value: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v"))))
    return samples.groupBy("image_id", "channel", "y").agg(F.transform(ordered, lambda s: s["v"]).alias("line"))


def _turned(samples: DataFrame) -> DataFrame:
    return samples.select("image_id", "channel", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def squeeze(samples: DataFrame, down: bool = False) -> DataFrame:
    """(image_id, channel, y, low, high): pairs of a line as mean and what is left of their difference beside the slope
    that means and the sample before suggest; the last sample of an odd line is a mean of its own. With ``down`` pairs
    are those of a column, whose number is y."""
    lines = _lines(_turned(samples) if down else samples, "v")
    pairs = F.expr("IF(size(line) < 2, CAST(array() AS array<int>), sequence(0, size(line) div 2 - 1))")
    mean = F.transform(pairs, lambda k: F.shiftright(F.get("line", 2 * k) + F.get("line", 2 * k + 1) + F.when(F.get("line", 2 * k) > F.get("line", 2 * k + 1), 1).otherwise(0), 1))
    low = F.when(F.size("line") % 2 == 1, F.concat(mean, F.array(F.get("line", F.size("line") - 1)))).otherwise(mean)
    lines = lines.withColumn("low", low)

    def left(k: Column) -> Column:
        a = F.get("low", k)
        before = F.when(k > 0, F.get("line", F.greatest(2 * k - 1, F.lit(0)))).otherwise(a)
        return F.get("line", 2 * k) - F.get("line", 2 * k + 1) - smooth_tendency(before, a, F.coalesce(F.get("low", k + 1), a))

    return lines.select("image_id", "channel", "y", "low", F.transform(pairs, left).alias("high"))


def squeeze_pairs(samples: DataFrame, down: bool = False) -> DataFrame:
    """(image_id, channel, y, k, low, high): what ``squeeze`` makes, a row for each pair k, high null where a last sample
    is alone. Lines, or columns, of any length pass through windows and are not gathered."""
    line = Window.partitionBy("image_id", "channel", "y").orderBy("x")
    at = {f"v{k}": F.lead("v", k).over(line) for k in (1, 2, 3)} | {"before": F.lag("v").over(line), "place": F.row_number().over(line) - 1}
    rows = (_turned(samples) if down else samples).withColumns(at).where("place % 2 = 0")

    def mean(one: str, two: str) -> Column:
        return F.when(F.col(two).isNull(), F.col(one)).otherwise(F.shiftright(F.col(one) + F.col(two) + F.when(F.col(one) > F.col(two), 1).otherwise(0), 1))

    rows = rows.withColumns({"low": mean("v", "v1"), "next": mean("v2", "v3")})
    high = F.col("v") - F.col("v1") - smooth_tendency(F.coalesce("before", "low"), F.col("low"), F.coalesce("next", "low"))
    return rows.select("image_id", "channel", "y", (F.col("place") / 2).cast("long").alias("k"), "low", high.cast("long").alias("high"))


def _tendency(b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``smooth_tendency`` of arrays."""

    def div(v: np.ndarray) -> np.ndarray:
        return np.sign(v) * (np.abs(v) // 12)

    slope, up, down = 4 * b - 3 * n - a, 2 * (b - a), 2 * (a - n)
    falls = div(slope + 6)
    falls = np.where(falls - falls % 2 > up, up + 1, falls)
    falls = np.where(falls + falls % 2 > down, down, falls)
    rises = div(slope - 6)
    rises = np.where(rises + rises % 2 < up, up - 1, rises)
    rises = np.where(rises - rises % 2 < down, down, rises)
    return np.where((b >= a) & (a >= n), falls, np.where((b <= a) & (a <= n), rises, 0))


def _samples_of_pairs(low: np.ndarray, after: np.ndarray, high: np.ndarray, begins: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Both samples of pairs in order, ``last`` being the sample before the first of them.

    All pairs are made from a guess of the sample before, then those whose sample before came out otherwise are made
    again until none is. Each round settles one pair of a line at least, and what is then left is the only solution.
    """
    first, second = np.empty_like(low), low.copy()
    at = np.arange(len(low))
    while len(at):
        a = low[at]
        before = np.where(begins[at], a, np.where(at > 0, second[at - 1], last))
        diff = high[at] + _tendency(before, a, after[at])
        first[at] = a + np.sign(diff) * (np.abs(diff) >> 1)
        made = first[at] - diff
        moved = at[made != second[at]] + 1
        second[at] = made
        moved = moved[moved < len(low)]
        at = moved[~begins[moved]]
    return first, second


def _unsqueezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (image_id, channel, y, k, low, next, high) in order of k to samples."""
    last = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, low, after = (batch.column(c).to_numpy() for c in (3, 4, 5))
        both = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
        first, second = _samples_of_pairs(low, after, batch.column(6).fill_null(0).to_numpy(), k == 0, last)
        last = int(second[-1])
        keep = np.stack([np.ones_like(both), both], 1).reshape(-1)
        values = np.stack([np.where(both, first, low), second], 1).reshape(-1)[keep]
        x, row = np.stack([2 * k, 2 * k + 1], 1).reshape(-1)[keep], pa.array(np.repeat(np.arange(len(k)), 2)[keep])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(3)), pa.array(x), pa.array(values)], ["image_id", "channel", "y", "x", "v"])


def _unsqueeze_sorted(rows: DataFrame, down: bool) -> DataFrame:
    """The samples of rows (image_id, channel, y, k, low, next, high); those of a line follow each other in order of k."""
    ready(rows.sparkSession)
    kinds = dict(rows.dtypes)
    made = rows.mapInArrow(_unsqueezed, f"image_id {kinds['image_id']}, channel {kinds['channel']}, y {kinds['y']}, x long, v long")
    return _turned(made) if down else made


def unsqueeze_pairs(pairs: DataFrame, down: bool = False) -> DataFrame:
    """The samples (image_id, channel, y, x, v) of the rows of ``squeeze_pairs``; lines stream through tasks, which hold a batch."""
    line = Window.partitionBy("image_id", "channel", "y").orderBy("k")
    rows = pairs.select("image_id", "channel", "y", "k", F.col("low").cast("long").alias("low"), F.coalesce(F.lead("low").over(line), "low").cast("long").alias("next"), F.col("high").cast("long").alias("high"))
    return _unsqueeze_sorted(rows.repartition("image_id", "channel", "y").sortWithinPartitions("image_id", "channel", "y", "k"), down)


def unsqueeze(squeezed: DataFrame, down: bool = False) -> DataFrame:
    """The samples (image_id, channel, y, x, v) of squeezed lines, or columns; each pair needs the sample made before it."""
    rows = squeezed.select("image_id", "channel", "y", "low", "high", F.posexplode("low").alias("k", "a"))
    after = F.coalesce(F.get("low", F.col("k") + 1), "a")
    return _unsqueeze_sorted(rows.select("image_id", "channel", "y", F.col("k").cast("long").alias("k"), F.col("a").cast("long").alias("low"), after.cast("long").alias("next"), F.get("high", F.col("k")).cast("long").alias("high")), down)


def permutation(code: Column) -> Column:
    """The permutation of a Lehmer code: each number picks among what is left."""
    return F.aggregate(
        code,
        F.struct(F.transform(F.sequence(F.lit(0), F.size(code) - 1), lambda i: i.cast("long")).alias("left"), F.expr("CAST(array() AS array<bigint>)").alias("out")),
        lambda acc, k: F.struct(
            F.filter(acc["left"], lambda v: v != F.get(acc["left"], k.cast("int"))).alias("left"),
            F.concat(acc["out"], F.array(F.get(acc["left"], k.cast("int")))).alias("out"),
        ),
    )["out"]


def unmove_to_front(places: DataFrame, key: str, order: str, size: int = 256) -> DataFrame:
    """(key, order, symbol) of rows (key, order, place): symbols of places in a list whose last used symbol moves to the front.

    Rows of a key stream through a task in order, which holds one list; keys are whole numbers.
    """
    ready(places.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, symbols = None, False, []
        for batch in batches:
            out = []
            for k, place in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != current:
                    current, begun, symbols = k, True, list(range(size))
                out.append(symbols.pop(place))
                symbols.insert(0, out[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], [key, order, "symbol"])

    rows = places.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col("place").cast("long")).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"{key} long, {order} long, symbol long")


def _table(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens ascending, their freq, their cum) of a table of at most its slots."""
    rows = sorted((r.token, r.freq, r.cum) for r in table.select("token", "freq", "cum").limit((1 << TABLE_BITS) + 1).collect())
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def rans_sections(tokens: DataFrame, table: DataFrame, section: str, order: str) -> DataFrame:
    """(section, words, tokens): each section's tokens as 16-bit words of a range coder over the table (token, freq,
    cum), which must be no larger than its 4,096 slots. Sections are coded apart, many of a task in step."""
    ready(tokens.sparkSession)
    known, freqs, cums = _table(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column(1).offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            flat = batch.column(1).flatten().to_numpy()
            at = np.searchsorted(known, flat)
            if len(flat) and not (known[np.minimum(at, len(known) - 1)] == flat).all():
                raise ValueError("a token is not in the table")
            state = np.full(len(counts), STATE, np.int64)
            word, sent = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
            for k in range(int(counts.max(initial=0)) - 1, -1, -1):
                live = np.flatnonzero(counts > k)
                place = starts[live] + k
                freq, x = freqs[at[place]], state[live]
                full = x >> (32 - TABLE_BITS) >= freq
                word[place], sent[place] = x & 0xFFFF, full
                x = np.where(full, x >> 16, x)
                state[live] = (x // freq << TABLE_BITS) + x % freq + cums[at[place]]
            # words come last in, first out: the state, then those of the tokens from the first on
            per = np.add.reduceat(np.append(sent, False), starts)[: len(counts)] * (counts > 0) if len(counts) else counts
            ends = np.cumsum(per + 2)
            out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
            heads = ends - per - 2
            out[heads], out[heads + 1] = state >> 16, state & 0xFFFF
            body = np.ones(len(out), bool)
            body[heads] = body[heads + 1] = False
            out[body] = word[sent]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out.astype(np.int32), per + 2, pa.int32()), pa.array(counts.astype(np.int64))], [section, "words", "tokens"])

    ordered = F.array_sort(F.collect_list(F.struct(order, F.col("token").cast("long").alias("token"))))
    rows = tokens.groupBy(F.col(section).cast("long").alias(section)).agg(ordered.alias("t")).select(section, F.col("t.token").alias("t"))
    return rows.mapInArrow(run, f"{section} long, words array<int>, tokens long")


def unrans_sections(sections: DataFrame, table: DataFrame, section: str) -> DataFrame:
    """(section, place, token) of coded sections; a section that does not end in the first state raises."""
    ready(sections.sparkSession)
    known, freqs, cums = _table(table)
    by = np.argsort(cums, kind="stable")
    slot = np.repeat(by, freqs[by])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column(2).to_numpy()
            words, sizes = batch.column(1).flatten().to_numpy().astype(np.int64), np.diff(batch.column(1).offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            ends, state = at + sizes, (words[at] << 16) | words[at + 1]
            at = at + 2
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
            out = np.zeros(int(counts.sum()), np.int64)
            padded = np.append(words, 0)
            for k in range(int(counts.max(initial=0))):
                live = np.flatnonzero(counts > k)
                x = state[live]
                low = x & ((1 << TABLE_BITS) - 1)
                token = slot[low]
                x = freqs[token] * (x >> TABLE_BITS) + low - cums[token]
                empty = x < 1 << 16
                state[live] = np.where(empty, (x << 16) | padded[np.minimum(at[live], len(words))], x)
                at[live] += empty
                out[starts[live] + k] = known[token]
            if bad := np.flatnonzero((state != STATE) | (at != ends)).tolist():
                raise ValueError(f"section {batch.column(0)[bad[0]].as_py()} does not end in the first state")
            place = np.arange(len(out)) - np.repeat(starts, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(place), pa.array(out)], [section, "place", "token"])

    return sections.select(section, "words", "tokens").mapInArrow(run, f"{section} long, place long, token long")
