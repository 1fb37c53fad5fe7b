"""Lengths of prefix codes with a bound, for many histograms at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselune.session import ready


def bounded_lengths(counts: list[int], longest: int = 15) -> list[int]:
    """A length of at most ``longest`` for each count, all of them positive, so that the code is complete.

    The two least weights merge until one is left, of equal ones those that are older. Depths beyond the bound are cut
    to it; then the rarest codes grow until all fit, and the most frequent ones shrink while there is room. A single
    count has length 1.
    """
    n = len(counts)
    if n < 3:
        return [1] * n
    if n > 1 << longest:
        raise ValueError(f"{n} tokens have no codes of {longest} bits")
    heap = [(c, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, int] = {}
    made = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = made
        heapq.heappush(heap, (a + b, made))
        made += 1
    depth = [0] * made
    for k in range(made - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    lengths = [min(longest, d) for d in depth[:n]]
    rarest = sorted(range(n), key=lambda k: (counts[k], -k))
    room = (1 << longest) - sum(1 << (longest - a) for a in lengths)
    while room < 0:
        for k in rarest:
            if lengths[k] < longest:
                lengths[k] += 1
                room += 1 << (longest - lengths[k])
                if room >= 0:
                    break
    while room > 0:
        for k in reversed(rarest):
            if lengths[k] > 1 and (gain := 1 << (longest - lengths[k])) <= room:
                lengths[k] -= 1
                room -= gain
                break
        else:
            break
    return lengths


def code_lengths_bounded(hist: DataFrame, *keys: str, longest: int = 15) -> DataFrame:
    """(keys, token, n, len) of histograms (keys, token, n): a histogram is one array, of ``2 ** longest`` tokens at most."""
    ready(hist.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bounded_lengths(counts, longest) for counts in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.int64()))], batch.schema.names)

    own = [F.col(k) for k in keys]
    one = hist.where("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("token", F.col("n").cast("long").alias("n")))).alias("t"))
    one = one.select(*own, F.col("t.token").alias("token"), F.col("t.n").alias("n"), F.col("t.n").alias("len"))
    out = one.mapInArrow(run, one.schema).select(*own, F.explode(F.arrays_zip("token", "n", "len")).alias("e"))
    return out.select(*own, "e.token", "e.n", F.col("e.len").cast("int").alias("len"))
