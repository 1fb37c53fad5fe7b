"""Exact duplicates: counting quotient filters built per partition, merged by sorted remainders.

A text's 64-bit fingerprint splits into a slice (its top bits), a quotient and a remainder. Every partition
builds one filter for each slice; filters of a slice merge without loss, as their sorted fingerprints do.
Only texts whose fingerprint counts more than one go on to be compared byte by byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, tune

_HEAD = struct.Struct("<BBQQ")


class QuotientFilter:
    """A static counting quotient filter over the low ``bits`` bits of fingerprints.

    Slots hold remainders sorted within the run of their quotient. One bit for each quotient tells whether
    its run exists, one for each slot whether its run ends there; so a remainder needs no quotient beside it.
    Counts of one take a byte; larger ones go to a list of their own.
    """

    def __init__(self, prints: np.ndarray, counts: np.ndarray, bits: int = 64):
        """prints: sorted and distinct."""
        self.bits, self.n = bits, len(prints)
        self.quotient_bits = max(1, min(24, int(self.n).bit_length()))
        shift = np.uint64(bits - self.quotient_bits)
        quotients = (prints >> shift).astype(np.int64)
        self.occupied = np.zeros(1 << self.quotient_bits, bool)
        self.occupied[quotients] = True
        self.run_end = np.append(quotients[1:] != quotients[:-1], True) if self.n else np.zeros(0, bool)
        self.remainders = prints & ((np.uint64(1) << shift) - np.uint64(1))
        self.counts = counts.astype(np.int64)

    @classmethod
    def of(cls, prints: np.ndarray, bits: int = 64) -> QuotientFilter:
        return cls(*np.unique(prints, return_counts=True), bits)

    def prints(self) -> np.ndarray:
        """The fingerprints, sorted."""
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotients << np.uint64(self.bits - self.quotient_bits)) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Counts add up; nothing is lost."""
        return QuotientFilter(*_summed((self.prints(), self.counts), (other.prints(), other.counts)), self.bits)

    def to_bytes(self) -> bytes:
        width = (self.bits - self.quotient_bits + 7) // 8
        many = np.flatnonzero(self.counts > 254)
        return b"".join((
            _HEAD.pack(self.bits, self.quotient_bits, self.n, len(many)),
            np.packbits(self.occupied).tobytes(),
            np.packbits(self.run_end).tobytes(),
            self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
            np.minimum(self.counts, 255).astype(np.uint8).tobytes(),
            self.counts[many].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        out = cls.__new__(cls)
        out.bits, out.quotient_bits, out.n, many = _HEAD.unpack_from(blob)
        width, at = (out.bits - out.quotient_bits + 7) // 8, _HEAD.size

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(blob, np.uint8, size, at - size)

        slots = 1 << out.quotient_bits
        out.occupied = np.unpackbits(take((slots + 7) // 8), count=slots).astype(bool)
        out.run_end = np.unpackbits(take((out.n + 7) // 8), count=out.n).astype(bool)
        wide = np.zeros((out.n, 8), np.uint8)
        wide[:, :width] = take(out.n * width).reshape(-1, width)
        out.remainders = wide.reshape(-1).view("<u8").astype(np.uint64)
        out.counts = take(out.n).astype(np.int64)
        out.counts[out.counts == 255] = take(8 * many).view("<i8")
        return out


def _summed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (distinct fingerprints, counts) as one."""
    prints, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(prints, kind="stable")  # merges two sorted runs
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def _filters(slice_bits: int):
    """Of each partition: a filter for each slice that has fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            runs.append(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
            while len(runs) > 1 and len(runs[-2][0]) <= 2 * len(runs[-1][0]):  # each fingerprint is merged a logarithm of times
                runs[-2:] = [_summed(*runs[-2:])]
        while len(runs) > 1:
            runs[-2:] = [_summed(*runs[-2:])]
        if not runs or not len(runs[0][0]):
            return
        own, counts = runs[0]
        bits = 64 - slice_bits
        ids = (own >> np.uint64(bits)).astype(np.int64) if slice_bits else np.zeros(len(own), np.int64)
        low = own & np.uint64((1 << bits) - 1)
        edges = np.flatnonzero(np.diff(ids, prepend=-1))
        for lo in range(0, len(edges), 256):
            part = edges[lo : lo + 256]
            ends = np.append(edges[lo + 1 : lo + 257], len(own))[: len(part)]
            blobs = [QuotientFilter(low[a:b], counts[a:b], bits).to_bytes() for a, b in zip(part, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int32()), pa.array(blobs, pa.binary())], ["slice", "filter"])

    return run


def _merged(slice_bits: int):
    """Of one slice: fingerprints that count more than one."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        filters = [QuotientFilter.from_bytes(x.as_py()) for x in group.column("filter")]
        while len(filters) > 1:  # pairs of like size, so that each fingerprint is sorted a logarithm of times
            filters = [a.merge(filters[k + 1]) if (k := 2 * i) + 1 < len(filters) else a for i, a in enumerate(filters[::2])]
        keep = filters[0].counts > 1
        top = np.uint64(key[0].as_py()) << np.uint64(64 - slice_bits) if slice_bits else np.uint64(0)
        return pa.table({"fp": pa.array((filters[0].prints()[keep] | top).view(np.int64)), "n": pa.array(filters[0].counts[keep])})

    return run


def repeated_fingerprints(prints: DataFrame, slice_rows: int = 500_000) -> DataFrame:
    """(fp, n) of the fingerprints in column ``fp`` that occur more than once; a slice has about ``slice_rows``."""
    slice_bits = max(4, (prints.count() // slice_rows).bit_length())
    filters = prints.select("fp").mapInArrow(_filters(slice_bits), "slice int, filter binary")
    return filters.groupBy("slice").applyInArrow(_merged(slice_bits), "fp long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each input row.

    Texts are equal when the same after lower-casing A-Z; a null text is an empty one. Of a group the
    largest id stays; a null id is smaller than any, and of rows that share the largest id one stays. keep_id is
    null only where all ids of a group are. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    upper = "".join(map(chr, range(65, 91)))
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, upper.lower())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    t = Scratch(spark)
    base = t.put(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")))
    repeats = t.put(repeated_fingerprints(base))
    n = repeats.count()
    routed = texts.withColumn("fp", F.xxhash64("norm")).join(small(repeats.select("fp"), n, 16), "fp", "left_semi")
    groups = routed.groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = t.put(groups.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    t.drop(repeats)
    same = ["fp", "text_sha256"]
    stays = base.join(small(groups, n, 120), same).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*same).agg(F.min("row").alias("stays"))
    groups = t.put(groups.join(stays, same))
    return base.join(small(groups, n, 128), same, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("stays"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
