"""Connected components of a table of links: by joins, or in one task where links are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links, 2 MB of them, that one task takes; bytes of a label in a broadcast.
HELD, LABEL_BYTES = 1 << 17, 32


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) to (v, label)."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while (above := up[v]) != v:
            up[v] = up[above]
            v = above
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(v) for v in list(up)], pa.int64())], ["v", "label"])


def components(links: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(v, label), counted, for each end of the n links (a, b): the smallest vertex that it reaches.

    No more than ``HELD`` links are joined in one task. For more, every round takes the least label among neighbours
    and then the label's label, so labels run along a path by doubling steps. Labels are a written table; neither
    links nor labels come to the driver, but for the broadcast of few labels. An empty table of links gives no rows.
    """
    if n <= HELD:
        return scratch.counted(links.select("a", "b").coalesce(1).mapInArrow(_trees, "v long, label long"))
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    both = scratch.put(both.where("u <> v").distinct())
    labels = scratch.counted(both.groupBy("v").agg(F.least(F.first("v"), F.min("u")).alias("label")))
    while True:
        known = scratch.small(labels, LABEL_BYTES).select("v", "label")
        near = both.join(known.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        lower = near.join(known, "v").select("v", "label", F.least("label", "near").alias("least"))
        jump = known.select(F.col("v").alias("least"), F.col("label").alias("far"))
        new = scratch.counted(lower.join(jump, "least", "left").select("v", F.least("least", "far").alias("label"), (F.least("least", "far") < F.col("label")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return scratch.view(labels.select("v", "label"), labels)
