"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

A suffix matters only through its first ``width`` bytes, its window. The first digit of a window is the least
hash of the ``seed``-byte strings in it: equal windows have equal first digits, and neighbouring windows mostly
share one, so a run of such windows is one piece of text. The first pass counts documents by first digit, and
text whose digits no two documents share is done with. The other digits are the window's bytes, eight at a time:
pieces of one first digit meet in a task, which sorts their windows digit by digit and goes on only with those
still equal to another. Groups that are equal after the last digit are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, tune
from .textkernel import hash_runs, loads, mix, slices

#: Windows of a piece; a piece's windows are told by the bits of a long.
PIECE = 32
#: Pieces of one first digit that one task sorts; more are dealt out by whole windows.
CROWD = 8192
#: Bytes of pieces that a task sorts at a time, if no group is larger.
CHUNK = 4 << 20
_SLICE = 1 << 17


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive hashes."""
    width = 1
    while width < span:
        step = min(width, span - width)
        hashes = np.minimum(hashes[: len(hashes) - step], hashes[step:])
        width += step
    return hashes


def _seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each ``seed`` bytes, eight at a time."""
    eights, n = np.ascontiguousarray(loads(data)), len(data) - seed + 1
    state = eights[:n] if seed >= 8 else eights[:n] & np.uint64((1 << 8 * seed) - 1)
    state = state * np.uint64(0x9FB21C651E98DF25)
    for at in [*range(8, seed - 8, 8), *[seed - 8] * (seed > 8)]:
        state ^= state >> np.uint64(32)
        state += eights[at : at + n]
        state *= np.uint64(0xD6E8FEB86659FD93)
    state ^= state >> np.uint64(29)
    state *= np.uint64(0xBF58476D1CE4E5B9)
    state ^= state >> np.uint64(32)
    return state


def pieces(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first digit, first window, windows) of the runs of windows of one first digit, ``PIECE`` windows at most.

    data are some texts one after the other; windows are inside of texts.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return np.zeros(0, np.uint64), none, none
    digit = _least(_seed_hashes(data, seed), width - seed + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    first, last = offsets[:-1], offsets[1:] - width + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    inside = np.cumsum(inside[: len(digit)], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (digit[1:] != digit[:-1]) | ~inside[:-1]
    end = inside.copy()
    end[:-1] &= new[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(end) + 1
    if len(lo) and (hi - lo).max() > PIECE:
        parts = -(-(hi - lo) // PIECE)
        run = np.repeat(np.arange(len(lo)), parts)
        k = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, hi = lo[run] + PIECE * k, np.minimum(hi[run], lo[run] + PIECE * (k + 1))
    return digit[lo], lo, hi - lo


def _lists(values: np.ndarray, kind: pa.DataType, owner: np.ndarray, rows: int) -> pa.Array:
    """Lists of the values by their ascending owners, one of ``rows`` each."""
    bounds = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def _digits(width: int, seed: int):
    """(doc_id, the first digits of its pieces, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), _SLICE):
                digit, at, _ = pieces(data, offsets, width, seed)
                owner = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(digit.view(np.int64), pa.int64(), owner, hi - lo)], ["doc_id", "digits"])

    return run


def _stretches(width: int, seed: int):
    """(doc_id, text, places of pieces) to (doc_id, starts, stretches): the text that the pieces cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            counts = np.diff(places.offsets.to_numpy())
            flat, base = places.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)])
            for lo, hi, data, offsets in slices(batch.column(1), _SLICE):
                _, at, n = pieces(data, offsets, width, seed)
                owner = np.repeat(np.arange(hi - lo), counts[lo:hi])
                chosen = np.sort(np.searchsorted(at, offsets[:-1])[owner] + flat[base[lo] : base[hi]])
                start, end = at[chosen], at[chosen] + n[chosen] + width - 1
                owner = np.searchsorted(offsets, start, "right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (start[1:] > end[:-1]) | (owner[1:] != owner[:-1])])[: len(start)])
                start, end, owner = start[cut], np.maximum.reduceat(end, cut) if len(cut) else end, owner[cut]
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                kept = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([kept, _lists((start - offsets[owner]).astype(np.int32), pa.int32(), owner, hi - lo), _lists(texts, pa.binary(), owner, hi - lo)], ["doc_id", "starts", "stretches"])

    return run


def _pieces_of(batch: pa.RecordBatch, width: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, first digit, start, end, doc_id, place in the document) of the pieces of rows of stretches."""
    ids = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
    starts, texts = batch.column(1).flatten().to_numpy(), batch.column(2).flatten()
    for lo, _, data, offsets in slices(texts, _SLICE):
        digit, at, n = pieces(data, offsets, width, seed)
        owner = np.searchsorted(offsets, at, "right") - 1
        yield data, digit, at, at + n + width - 1, ids[lo + owner], starts[lo + owner] + at - offsets[owner]


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary values of the ranges of bytes."""
    sizes = end - start
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    taken = data[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], sizes)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(taken)])


def _contents(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, digit, start, end, ids, _ in _pieces_of(batch, width, seed):
                yield pa.RecordBatch.from_arrays([pa.array(digit.view(np.int64)), _cut(data, start, end), pa.array(ids)], ["digit", "piece", "doc_id"])

    return run


def _places(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, _, start, end, ids, place in _pieces_of(batch, width, seed):
                keys = hash_runs(data, start, end)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(place.astype(np.int32))], ["key", "doc_id", "place"])

    return run


def equal_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that equal another of their group, sorted, and where each group of equal ones begins.

    starts: first bytes of the windows; group: ascending. Digits are eight bytes, most significant first; after
    each pass windows that equal no other so far are left out.
    """
    digits = np.ascontiguousarray(loads(data)).byteswap()
    kept = np.arange(len(starts))
    for at in [None, *range(0, width - 8, 8), max(0, width - 8)]:
        new = np.ones(len(kept), bool)
        if at is not None:
            digit = digits[starts[kept] + at] if width >= 8 else digits[starts[kept]] >> np.uint64(64 - 8 * width)
            order = np.lexsort((digit, group))
            kept, group, digit = kept[order], group[order], digit[order]
            new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            new[1:] = group[1:] != group[:-1]
        many = ~(new & np.append(new[1:], True))
        kept, new = kept[many], new[many]
        group = np.cumsum(new)
    return kept, np.flatnonzero(new) if len(kept) else kept


def _windows(sizes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first byte, place in the piece) of all windows of pieces."""
    n = sizes - width + 1
    piece = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    return piece, offsets[piece] + place, place


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sorted_firsts(width: int):
    """Pieces (digit, piece, low, high), sorted by digit, to (key, first, windows): windows that start first in document ``first``."""

    def firsts(t: pa.Table) -> pa.RecordBatch:
        data, offsets = _bytes(t.column("piece"))
        digit, low, high = (t.column(c).to_numpy() for c in ("digit", "low", "high"))
        piece, start, place = _windows(np.diff(offsets), offsets[:-1], width)
        first = low[piece]
        group = np.cumsum(np.concatenate([[True], digit[1:] != digit[:-1]]))[piece]
        kept, begins = equal_groups(data, start, group, width)
        if len(kept):
            ends = np.append(begins[1:], len(kept))
            first[kept] = np.repeat(np.minimum.reduceat(first[kept], begins), ends - begins)
        use = np.flatnonzero(first < high[piece])  # else no document comes later
        piece, first, bit = piece[use], first[use], np.uint64(1) << place[use].astype(np.uint64)
        order = np.lexsort((first, piece))
        piece, first, bit = piece[order], first[order], bit[order]
        cut = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (first[1:] != first[:-1])])[: len(piece)])
        windows = np.bitwise_or.reduceat(bit, cut) if len(cut) else bit
        keys = hash_runs(data, offsets[:-1], offsets[1:])[piece[cut]]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(first[cut]), pa.array(windows.view(np.int64))], ["key", "first", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK or not batch.num_rows:
                continue
            t = pa.Table.from_batches(held)
            digit = t.column("digit").to_numpy()
            cut = int(np.searchsorted(digit, digit[-1]))  # the last group may go on
            if cut:
                yield firsts(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if sum(b.num_rows for b in held):
            yield firsts(pa.Table.from_batches(held))

    return run


def _whole_windows(width: int):
    """Pieces of crowded digits to (window, key, bit, low, high), a row a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                t = pa.Table.from_batches([batch.slice(at, 512)])
                data, offsets = _bytes(t.column("piece"))
                piece, start, place = _windows(np.diff(offsets), offsets[:-1], width)
                keys = hash_runs(data, offsets[:-1], offsets[1:])[piece]
                columns = [_cut(data, start, start + width), pa.array(keys.view(np.int64)), pa.array((np.uint64(1) << place.astype(np.uint64)).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(t.column(c).to_numpy()[piece]) for c in ("low", "high"))], ["window", "key", "bit", "low", "high"])

    return run


def _kept(width: int, with_bytes: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]
    kinds = [pa.int64()] * 4 + [pa.string(), *[pa.binary()] * with_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0), batch.column(2)
            for lo, _, data, offsets in slices(batch.column(1)):
                rows = []
                for k in range(len(offsets) - 1):
                    text, spans = data[offsets[k] : offsets[k + 1]], 0
                    left = text
                    if found[lo + k].is_valid:
                        hits = found[lo + k].values
                        place, bits = hits.field(0).to_numpy(), hits.field(1).to_numpy().view(np.uint64)
                        row, bit = np.nonzero((bits[:, None] >> np.arange(PIECE, dtype=np.uint64)) & np.uint64(1))
                        cover = np.zeros(len(text) + 1, np.int32)
                        at = np.unique(place[row] + bit)
                        cover[at] += 1
                        cover[at + width] -= 1
                        gone = np.cumsum(cover)[:-1] > 0
                        spans, left = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]), text[~gone]
                    rows.append((ids[lo + k].as_py(), len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), *[left.tobytes()] * with_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, seed: int = 20, crowd: int = CROWD, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes ``kept`` if asked for), a row for each document.

    A text is its UTF-8 bytes, a null text none. A byte goes if a window of ``width`` bytes covers it that also
    starts in a document with a smaller id; windows are those of the input and lie inside of one document.
    ``n_spans`` counts the maximal runs that go. Of documents that share a window the smallest id keeps it; repeats
    within one document stay. Ids must be unique; documents of a null id stay whole, a row each, and take nothing from
    others. Texts shorter than a window stay whole; an empty table gives no rows; other columns are ignored.
    Windows are compared byte by byte; what pieces of text they make up is then known by 64-bit hashes.
    """
    spark = docs.sparkSession
    tune(spark)
    seed, t = max(1, min(seed, width)), Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = t.put(texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width)).mapInArrow(_digits(width, seed), "doc_id long, digits array<long>"))
    digits = marks.select("doc_id", F.posexplode("digits").alias("place", "digit"))
    shared = t.put(digits.groupBy("digit").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("digit"))
    near = t.put(digits.join(shared.hint("shuffle_hash"), "digit").groupBy("doc_id").agg(F.collect_list("place").alias("places")))
    t.drop(marks, shared)
    covered = texts.join(near.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places").mapInArrow(_stretches(width, seed), "doc_id long, starts array<int>, stretches array<binary>")
    covered = t.put(covered)
    t.drop(near)
    distinct = covered.mapInArrow(_contents(width, seed), "digit long, piece binary, doc_id long")
    distinct = t.put(distinct.groupBy("digit", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    crowds = t.put(distinct.groupBy("digit").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("digit"))
    n = crowds.count()
    firsts = distinct.join(small(crowds, n, 16), "digit", "left_anti") if n else distinct
    firsts = firsts.repartition("digit").sortWithinPartitions("digit").mapInArrow(_sorted_firsts(width), "key long, first long, windows long")
    if n:
        whole = distinct.join(small(crowds, n, 16), "digit").select("digit", "piece", "low", "high").drop("digit").mapInArrow(_whole_windows(width), "window binary, key long, bit long, low long, high long")
        least = t.put(whole.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").drop("last"))
        crowded = whole.join(least.hint("shuffle_hash"), "window").where("high > first").groupBy("key", "first").agg(F.bit_or("bit").alias("windows"))
        firsts = firsts.unionByName(crowded)
    firsts = t.put(firsts)
    t.drop(distinct, crowds)
    places = covered.mapInArrow(_places(width, seed), "key long, doc_id long, place int")
    hits = places.join(firsts.hint("shuffle_hash"), "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct("place", "windows")).alias("hits"))
    hits = t.put(hits)
    t.drop_all_but(hits)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return texts.join(hits, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(_kept(width, with_bytes), schema)
