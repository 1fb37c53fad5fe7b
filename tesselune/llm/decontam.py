"""Benchmark decontamination by greedy string tiling (Wise 1993): tiles found by running Karp-Rabin.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z, so punctuation, case and
spacing do not hide a passage. Documents and benchmark items that share the hashes of ``seed`` consecutive
words at places enough are tiled: search lengths fall from the item's length to ``seed``; at each length the
hashes of all unmarked windows are matched, matches are grown, and the longest are marked first so that tiles
never overlap; what is left of a match that lost words to a longer one waits for its new length. Tiles may lie in
any order, so passages whose parts were moved about are covered too.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .textkernel import NOT_ALNUM, Words, slices, windows

#: A benchmark of at most so many characters in all is sent to every task; a larger one is joined by shuffles.
BROADCAST_CHARS = 32 << 20


def _matches(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(-size, place in item, place in doc) of grown matches of ``length`` unmarked words or more, longest first."""
    sides = []
    for words, free in ((item, free_item), (doc, free_doc)):
        used = np.concatenate([[0], np.cumsum(~free)])
        n = max(0, len(words) - length + 1)
        places = np.flatnonzero(used[length : length + n] == used[:n])
        sides.append((places, windows(words, length)[places]))
    (at_item, x), (at_doc, y) = sides
    order = np.argsort(y, kind="stable")
    lo, hi = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
    out = []
    for k in np.flatnonzero(hi > lo):
        i = int(at_item[k])
        for j in at_doc[order[lo[k] : hi[k]]].tolist():
            if i and j and free_item[i - 1] and free_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # the same match, one word on
            m = min(len(item) - i, len(doc) - j)
            same = (item[i : i + m] == doc[j : j + m]) & free_item[i : i + m] & free_doc[j : j + m]
            size = m if same.all() else int(np.argmin(same))
            if size >= length:
                out.append((-size, i, j))
    return sorted(out)


def tile(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles; both are arrays of word hashes.

    The longest common run of unmarked words is marked first, of equal ones that first in the item and then in the doc.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    seed = max(1, min(seed, len(item)))
    tiles: list[tuple[int, int, int]] = []
    length = len(item)
    while len(item):
        queue = _matches(item, doc, free_item, free_doc, length)  # sorted, so a heap
        while queue:
            size, i, j = heapq.heappop(queue)
            free = free_item[i : i - size] & free_doc[j : j - size]
            if free.all():
                free_item[i : i - size] = free_doc[j : j - size] = False
                tiles.append((i, j, -size))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if hi - lo >= length:
                    heapq.heappush(queue, (lo - hi, i + lo, j + lo))
        if length == seed:
            break
        length = max(seed, length // 2)
    return tiles


def _word_hashes(texts: pa.Array) -> list[np.ndarray]:
    return [words.of(k) for _, _, data, offsets in slices(texts) for words in [Words(data, offsets, lower=True, breaks=NOT_ALNUM)] for k in range(len(offsets) - 1)]


def _seeds(own: np.ndarray, seed: int) -> np.ndarray:
    return windows(own, max(1, min(seed, len(own))))


def seeds_asked(n_words: int, seed: int, least: float) -> int:
    """Places of an item whose seeds a document must have for its tiles to cover ``least`` of the item.

    Tiles of c words in all hold at least c / seed places of seeds, as each has ``seed`` words or more.
    """
    return max(1, math.ceil(least * n_words / max(1, min(seed, n_words)) - 1e-9))


_SCHEMA = "doc_id long, item_id long, item_words long, tiles long, covered long, coverage double"


def _report(rows: list[tuple[int, int, np.ndarray, np.ndarray]], seed: int, least: float) -> pa.RecordBatch:
    out = []
    for doc_id, item_id, doc, item in rows:
        tiles = tile(item, doc, seed)
        covered = sum(t[2] for t in tiles)
        if tiles and covered >= least * len(item):
            out.append((doc_id, item_id, len(item), len(tiles), covered, covered / len(item)))
    columns = zip(*out, strict=True) if out else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(columns)], [f.split()[0] for f in _SCHEMA.split(", ")])


def _against_all(item_ids: list[int], items: list[np.ndarray], seed: int, least: float):
    """Documents against all items, which are few enough to be here."""
    full = [np.unique(_seeds(item, seed), return_counts=True) for item in items]
    hashes, places = (np.concatenate([np.zeros(0, t), *(x[k] for x in full)]) for k, t in ((0, np.uint64), (1, np.int64)))
    owner = np.repeat(np.arange(len(items)), [len(x[0]) for x in full])
    order = np.argsort(hashes, kind="stable")
    hashes, owner, places = hashes[order], owner[order], places[order]
    asked = np.array([seeds_asked(len(item), seed, least) for item in items], np.int64)
    lengths = sorted({min(seed, len(item)) for item in items if len(item)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), _word_hashes(batch.column(1)), strict=True):
                hits = np.unique(np.concatenate([np.zeros(0, np.uint64), *(windows(own, n) for n in lengths)]))
                lo, hi = np.searchsorted(hashes, hits), np.searchsorted(hashes, hits, "right")
                hit = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                near, which = np.unique(owner[hit], return_inverse=True)
                near = near[np.bincount(which, places[hit], len(near)) >= asked[near]]
                rows += [(doc_id, item_ids[k], own, items[k]) for k in near.tolist()]
            yield _report(rows, seed, least)

    return run


def _item_seeds(seed: int, least: float):
    """(hash, item, places, asked): each distinct seed of an item, at how many places it stands, and how many are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), _word_hashes(batch.column(1)), strict=True):
                if len(own):
                    hashes, places = np.unique(_seeds(own, seed), return_counts=True)
                    columns = [hashes.view(np.int64), np.full(len(hashes), key), places, np.full(len(hashes), seeds_asked(len(own), seed, least))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["hash", "item", "places", "asked"])

    return run


def _doc_seeds(lengths: list[int]):
    """(hash, doc): each distinct seed of a document, for all lengths of seeds that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), _word_hashes(batch.column(1)), strict=True):
                if len(own):
                    found = np.unique(np.concatenate([windows(own, n) for n in lengths]))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), key))], ["hash", "doc"])

    return run


def _tiled(seed: int, least: float):
    """(doc_id, text, items) to the report, item after item; a document's words are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, own, near in zip(batch.column(0).to_pylist(), _word_hashes(batch.column(1)), batch.column(2), strict=True):
                ids, texts = near.values.field(0).to_pylist(), near.values.field(1)
                yield _report([(doc_id, k, own, item) for k, item in zip(ids, _word_hashes(texts), strict=True)], seed, least)

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    seed: int = 5,
    least: float = 0.5,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """(doc_id, item_id, item_words, tiles, covered, coverage) of documents whose tiles cover ``least`` of an item's words.

    A row for each such pair; documents without a row are clean. Tiles have ``seed`` words or more; a shorter
    item must occur whole. Null and empty texts match nothing; equal documents or items, and rows of null or
    repeated ids, are reported each on their own; either table may be empty. Other columns are ignored. Words are
    compared by 64-bit hashes. A benchmark beyond ``broadcast_chars`` is joined by seeds; the rows are the same.
    There texts meet their items by a hash of the text, so ids play no part; a document's items are one list.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("item_text"))
    if (items.agg(F.sum(F.length("item_text"))).first()[0] or 0) <= broadcast_chars:
        rows = items.collect()
        hashes = _word_hashes(pa.array([r.item_text for r in rows], pa.string()))
        return texts.mapInArrow(_against_all([r.item_id for r in rows], hashes, seed, least), _SCHEMA)
    items, texts = items.withColumn("item", F.xxhash64("item_text")), texts.withColumn("doc", F.xxhash64("text"))
    of_items = items.select("item", "item_text").mapInArrow(_item_seeds(seed, least), "hash long, item long, places long, asked long").distinct()
    of_docs = texts.select("doc", "text").mapInArrow(_doc_seeds(list(range(1, seed + 1))), "hash long, doc long").distinct()
    pairs = of_docs.join(of_items, "hash").groupBy("doc", "item").agg(F.sum("places").alias("found"), F.first("asked").alias("asked")).where("found >= asked")
    near = pairs.join(items, "item").groupBy("doc").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    return texts.join(near, "doc").select("doc_id", "text", "items").mapInArrow(_tiled(seed, least), _SCHEMA)
