"""Repeated passages: windows of ``width`` words that also start in a document with a smaller id.

Anchors are shorter windows at places whose residue modulo the period lies in a difference cover: for any
two residues some shift below the period brings both into the cover. So two equal windows, wherever they
start, share an equal anchor at the same shift inside. Anchors that two documents share extend to the full
windows around them, and only those windows are compared; no pairs of documents are ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune
from .textkernel import Words, slices, windows


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` occurs among them.

    For period q*q+q+1 with q prime these are q+1 (Singer's sets are as small); found here by a greedy
    search with backtracking, and, should that not end soon, by the plain cover of small and large steps.
    """
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    budget = [200_000]

    def search(chosen: list[int], seen: set[int]) -> list[int] | None:
        if len(seen) == period:
            return chosen
        budget[0] -= 1
        if len(chosen) == size or budget[0] < 0:
            return None
        for x in range(chosen[-1] + 1, period):
            new = {(x - c) % period for c in chosen} | {(c - x) % period for c in chosen}
            if size * (size - 1) + 1 == period and new & seen:
                continue
            if found := search([*chosen, x], seen | new):
                return found
        return None

    if found := search([0], {0}):
        return found
    step = int(np.ceil(np.sqrt(period)))
    return sorted({*range(step), *range(0, period, step), period - 1})


def _anchors(width: int, period: int, cover: list[int]):
    """(doc_id, the hashes of its anchors, in order)."""
    length = width - period + 1
    member = np.zeros(period, bool)
    member[cover] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                words, hashes, ends = Words(data, offsets), [np.zeros(0, np.uint64)], [0]
                for k in range(len(offsets) - 1):
                    own = words.of(k)
                    if len(own) >= width:
                        hashes.append(windows(own, length)[member[np.arange(len(own) - length + 1) % period]])
                    ends.append(ends[-1] + (len(hashes[-1]) if len(own) >= width else 0))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "hashes"])

    return run


def _starts(width: int, period: int, places: np.ndarray, n_windows: int) -> np.ndarray:
    """Windows that hold one of the anchors at the places."""
    near = np.zeros(n_windows + width + 1, np.int32)
    np.add.at(near, np.maximum(places - period + 1, 0), 1)
    np.add.at(near, places + 1, -1)
    return np.flatnonzero(np.cumsum(near)[:n_windows] > 0)


def _windows(width: int, period: int, cover: list[int]):
    """(doc_id, text, numbers of its shared anchors) to (doc_id, hashes, starts) of the windows around them."""
    residues = np.array(sorted(cover))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(2)
            for lo, hi, data, offsets in slices(batch.column(1)):
                words, hashes, starts, ends = Words(data, offsets), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0]
                for k in range(len(offsets) - 1):
                    own, n = windows(words.of(k), width), np.asarray(numbers[lo + k].values)
                    at = _starts(width, period, n // len(residues) * period + residues[n % len(residues)], len(own))
                    hashes.append(own[at])
                    starts.append(at)
                    ends.append(ends[-1] + len(at))
                bounds = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (np.concatenate(hashes).view(np.int64), np.concatenate(starts).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], ["doc_id", "hashes", "starts"])

    return run


def _kept(width: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0), batch.column(2)
            for lo, _, data, offsets in slices(batch.column(1)):
                words, raw = Words(data, offsets), data.tobytes()
                rows = []
                for k in range(len(offsets) - 1):
                    a, b = int(words.bounds[k]), int(words.bounds[k + 1])
                    keep = np.ones(b - a, bool)
                    if found[lo + k].is_valid:
                        cover = np.zeros(b - a + 1, np.int32)
                        starts = np.asarray(found[lo + k].values)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + width, -1)
                        keep = np.cumsum(cover)[:-1] == 0
                    places = a + np.flatnonzero(keep)
                    text = b" ".join([raw[i:j] for i, j in zip(words.starts[places].tolist(), words.ends[places].tolist(), strict=True)])
                    rows.append((ids[lo + k].as_py(), b - a, b - a - len(places), hashlib.sha256(text).hexdigest(), *[text.decode()] * with_text))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return run


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, period: int = 31, with_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for), a row for each document.

    Words are runs of bytes other than space and tab to carriage return. A word goes if a window of ``width``
    words covers it whose words also start in a document with a smaller id; windows are those of the input.
    A null text has no words; texts shorter than a window stay whole. Ids must be unique. Windows are compared
    by 64-bit hashes. Of documents that share a passage the smallest id keeps it. A null id is neither smaller
    nor larger than another, as in SQL: its documents stay whole, a row each. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    period, t = min(period, width), Scratch(spark)
    cover = difference_cover(period)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # texts are hashed once for anchors and once for windows: what is counted and then joined is read back from tables
    marks = t.put(texts.where("doc_id IS NOT NULL").mapInArrow(_anchors(width, period, cover), "doc_id long, hashes array<long>"))
    anchors = marks.select("doc_id", F.posexplode("hashes").alias("number", "hash"))
    shared = t.put(anchors.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash"))
    near = t.put(anchors.join(shared.hint("shuffle_hash"), "hash").groupBy("doc_id").agg(F.collect_list("number").alias("numbers")))
    t.drop(marks, shared)
    full = texts.join(near.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "numbers").mapInArrow(_windows(width, period, cover), "doc_id long, hashes array<long>, starts array<int>")
    full = t.put(full)
    t.drop(near)
    full = t.view(full.select("doc_id", F.explode(F.arrays_zip("hashes", "starts")).alias("w")).select("doc_id", F.col("w.hashes").alias("hash"), F.col("w.starts").alias("start")), full)
    first = t.put(full.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first"))
    found = t.put(full.join(first.hint("shuffle_hash"), "hash").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("start").alias("starts")))
    t.drop_all_but(found)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(found, "doc_id", "left").select("doc_id", "text", "starts").mapInArrow(_kept(width, with_text), schema)
