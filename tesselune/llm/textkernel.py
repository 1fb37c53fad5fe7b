"""Words, word hashes and shingle hashes of whole texts, vectorised over the bytes of an Arrow column.

A batch is taken in slices of whole documents of about ``SLICE`` bytes, so temporary arrays stay small;
one longer document is a slice of its own, and its words are still hashed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (Steele, Lea and Flood 2014), over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64 values by a rule, alike on every machine."""
    return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes that end a word: the space, and tab to carriage return.
SPACES = byte_set(b" \t\n\v\f\r")
#: The same and all ASCII punctuation, for matching that ignores punctuation.
NOT_ALNUM = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))

_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A word of more bytes than this is hashed by blake2b.
LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, also cut at the given places."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, little end first; zeros follow the last byte. A view of a copy, not aligned."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of bytes.

    Eight bytes at a time are mixed into the state of a run; no sum of powers is formed, so no word is the
    algebraic twin of another, as words of Thue and Morse are under polynomials modulo 2**64.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    rows, at, left = np.arange(len(starts)), starts.astype(np.int64), sizes.astype(np.int64)
    wide = sizes > LONG
    if wide.any():
        for k in np.flatnonzero(wide).tolist():
            run = data[starts[k] : ends[k]]
            out[k] = int.from_bytes(hashlib.blake2b((_LOWER[run] if lower else run).tobytes(), digest_size=8).digest(), "little")
        rows, at, left = rows[~wide], at[~wide], left[~wide]
    eights = loads(_LOWER[data] if lower else data)
    while len(rows):
        word = eights[at]
        word &= _MASKS[np.minimum(left, 8)]
        word += out[rows] * _MULTIPLIER
        out[rows] = mix(word)
        more = np.flatnonzero(left > 8)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


class Words:
    """Words of some whole documents: byte places, hashes, and the range of words of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACES, marks: bool = False):
        inside = ~breaks[data]
        self.starts, self.ends = _runs(inside, offsets)
        if marks:  # runs of ASCII punctuation are words too
            starts, ends = _runs(NOT_ALNUM[data] & ~SPACES[data], offsets)
            order = np.argsort(np.concatenate([self.starts, starts]), kind="stable")
            self.starts, self.ends = np.concatenate([self.starts, starts])[order], np.concatenate([self.ends, ends])[order]
        self.hashes = hash_runs(data, self.starts, self.ends, lower)
        self.bounds = np.searchsorted(self.starts, offsets)

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, in order; empty when there are fewer.

    Hashes of 1, 2, 4, ... words come from two of half the width, and the last from two that overlap.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width = hashes, 1
    while width < k:
        step = min(width, k - width)
        out = mix(out[: len(out) - step] * _MULTIPLIER + out[step:] + np.uint64(step))
        width += step
    return out if k > 1 else mix(out)
