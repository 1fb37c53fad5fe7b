"""Samples that need the ones before: the self-correcting predictor, and trees whose leaves predict in their own way.

The predictor weighs four guesses by how they did on the samples before. A sample needs its left neighbour and three of
the line above, so all samples with the same x + 2y can be made at once: many tiles step together along these
slanting lines, as numpy arrays. Tiles of bounded size are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselune.operators.neighbours import tiled
from tesselune.session import ready

#: Factors of the second, third and fourth guess, and the largest weights.
FACTOR_N, FACTOR_W, FACTORS, LARGEST = 16, 10, (7, 7, 7, 0, 0), (13, 12, 12, 12)
#: Tiles that step together.
TOGETHER = 64
#: The number of the predictor that corrects itself, and of the property that tells its error.
SELF_CORRECTING, ERROR = 6, 15


class Leaf(NamedTuple):
    """How a leaf predicts: a sample is the prediction + offset + multiplier * residual."""

    predictor: int
    offset: int = 0
    multiplier: int = 1


def _bits(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


class Near:
    """The neighbours of the samples (ys, xs) of all tiles, with the fallbacks at a tile's edges."""

    def __init__(self, v: np.ndarray, ys: np.ndarray, xs: np.ndarray):
        self.v, self.ys, self.xs = v, ys, xs
        self.up, self.left, self.right = (ys > 0)[:, None], (xs > 0)[:, None], (xs + 1 < v.shape[1])[:, None]
        above = self.at(v, -1, 0)
        self.w = np.where(self.left, self.at(v, 0, -1), np.where(self.up, above, 0))
        self.n = np.where(self.up, above, self.w)
        self.nw = np.where(self.left & self.up, self.at(v, -1, -1), np.where(self.left, self.w, self.n))
        self.ne = np.where(self.right & self.up, self.at(v, -1, 1), self.n)
        self.ww = np.where((xs > 1)[:, None], self.at(v, 0, -2), self.w)
        self.nn = np.where((ys > 1)[:, None], self.at(v, -2, 0), self.n)

    def at(self, a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        return a[np.maximum(self.ys + dy, 0), np.clip(self.xs + dx, 0, a.shape[1] - 1)]


class SelfCorrecting:
    """Errors of tiles of one shape, with three fractional bits inside."""

    def __init__(self, shape: tuple[int, int, int]):
        self.wrong = np.zeros(shape, np.int64)  # of the prediction
        self.each = [np.zeros(shape, np.int64) for _ in range(4)]  # of each guess

    def predict(self, near: Near) -> tuple[np.ndarray, np.ndarray]:
        """The prediction in eighths, and the neighbours' error of largest size, of equal ones that of w, n, nw, ne in turn."""
        up, left, right = near.up, near.left, near.right
        te_n = np.where(up, near.at(self.wrong, -1, 0), 0)
        te_w = np.where(left, near.at(self.wrong, 0, -1), 0)
        te_nw = np.where(left, np.where(up, near.at(self.wrong, -1, -1), 0), te_n)
        te_ne = np.where(right, np.where(up, near.at(self.wrong, -1, 1), 0), te_n)
        largest = te_w
        for other in (te_n, te_nw, te_ne):
            largest = np.where(np.abs(other) > np.abs(largest), other, largest)
        w, n, nw, ne, nn = (a * 8 for a in (near.w, near.n, near.nw, near.ne, near.nn))
        total = te_n + te_w
        self.guesses = (
            w + ne - n,
            n - ((total + te_ne) * FACTOR_N >> 5),
            w - ((total + te_nw) * FACTOR_W >> 5),
            n - (te_nw * FACTORS[0] + te_n * FACTORS[1] + te_ne * FACTORS[2] + (nn - n) * FACTORS[3] + (nw - w) * FACTORS[4] >> 5),
        )
        weights = []
        for e, largest_weight in zip(self.each, LARGEST, strict=True):
            # the error left of a sample counts beside that above it
            above = np.where(up, near.at(e, -1, 0), 0) + np.where(left, near.at(e, 0, -1), 0)
            s = above + np.where(right, np.where(up, near.at(e, -1, 1), 0), above)
            s += np.where(left, np.where(up, near.at(e, -1, -1), 0) + np.where((near.xs > 1)[:, None], near.at(e, 0, -2), 0), above)
            shift = np.maximum(0, _bits(s + 1) - 6)
            weights.append(4 + (largest_weight * ((1 << 24) // ((s >> shift) + 1)) >> shift))
        scale = _bits(sum(weights)) - 5
        weights = [a >> scale for a in weights]
        whole = sum(weights)
        last = ((whole >> 1) - 1 + sum(a * g for a, g in zip(weights, self.guesses, strict=True))) * ((1 << 24) // whole) >> 24
        inside = np.clip(last, np.minimum(np.minimum(w, n), ne), np.maximum(np.maximum(w, n), ne))
        self.last = np.where((te_n ^ te_w) | (te_n ^ te_nw) <= 0, inside, last)
        return self.last, largest

    def seen(self, near: Near, v: np.ndarray) -> None:
        self.wrong[near.ys, near.xs] = self.last - v * 8
        for e, g in zip(self.each, self.guesses, strict=True):
            e[near.ys, near.xs] = np.abs(g - v * 8) + 3 >> 3


def _gradient(a: Near) -> np.ndarray:
    return np.clip(a.w + a.n - a.nw, np.minimum(a.w, a.n), np.maximum(a.w, a.n))


def _prediction(kind: int, a: Near, corrected: np.ndarray | None) -> np.ndarray:
    simple = {
        0: lambda: np.zeros_like(a.w), 1: lambda: a.w, 2: lambda: a.n, 3: lambda: a.w + a.n >> 1,
        4: lambda: np.where(np.abs(a.w - a.nw) < np.abs(a.n - a.nw), a.n, a.w), 5: lambda: _gradient(a), 6: lambda: corrected + 3 >> 3,
        7: lambda: a.ne, 8: lambda: a.nw, 9: lambda: a.ww, 10: lambda: a.w + a.nw >> 1, 11: lambda: a.nw + a.n >> 1,
        12: lambda: a.n + a.ne >> 1, 13: lambda: a.w + a.n + a.ne + a.nw >> 2,
    }
    return simple[kind]()


def _property(k: int, a: Near, fixed: tuple[np.ndarray, np.ndarray], error: np.ndarray | None) -> np.ndarray:
    shape = a.w.shape
    values = {
        0: lambda: np.broadcast_to(fixed[0], shape), 1: lambda: np.broadcast_to(fixed[1], shape), 2: lambda: np.broadcast_to(a.ys[:, None], shape), 3: lambda: np.broadcast_to(a.xs[:, None], shape),
        4: lambda: np.abs(a.n), 5: lambda: np.abs(a.w), 6: lambda: a.n, 7: lambda: a.w, 8: lambda: a.w - a.n, 9: lambda: a.w + a.n - a.nw, 10: lambda: a.w - a.nw,
        11: lambda: a.nw - a.n, 12: lambda: a.n - a.ne, 13: lambda: a.n - a.nn, 14: lambda: a.w - a.ww, 15: lambda: error,
    }
    return values[k]()


def _leaves(tree: tuple | Leaf) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else _leaves(tree[2]) + _leaves(tree[3])


def _asked(tree: tuple | Leaf) -> set[int]:
    return set() if isinstance(tree, Leaf) else {tree[0]} | _asked(tree[2]) | _asked(tree[3])


def lockstep(values: np.ndarray, tree: tuple | Leaf, decode: bool, channel: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residuals or samples, leaves, errors) of tiles (height, width, tiles): all samples of x + 2y at once."""
    height, width, tiles = values.shape
    leaves, asked = _leaves(tree), _asked(tree)
    state = SelfCorrecting(values.shape) if ERROR in asked or any(a.predictor == SELF_CORRECTING for a in leaves) else None
    v, out, reached, errors = np.zeros_like(values), np.zeros_like(values), np.zeros(values.shape, np.int64), np.zeros(values.shape, np.int64)
    for t in range(width + 2 * height - 2):
        ys = np.arange(max(0, -((width - 1 - t) // 2)), min(height - 1, t // 2) + 1)
        if not len(ys):
            continue
        near = Near(v, ys, xs := t - 2 * ys)
        corrected, error = state.predict(near) if state else (None, None)
        leaf = np.zeros((len(ys), tiles), np.int64)
        guess, factor = np.zeros_like(leaf), np.ones_like(leaf)

        def walk(node: tuple | Leaf, number: int, here: np.ndarray) -> int:
            """Predicts where ``here`` holds; the next leaf's number."""
            if isinstance(node, Leaf):
                leaf[here] = number
                guess[here] = _prediction(node.predictor, near, corrected)[here] + node.offset
                factor[here] = node.multiplier
                return number + 1
            prop, split, left, right = node
            above = _property(prop, near, (channel, group), error) > split
            return walk(right, walk(left, number, here & above), here & ~above)

        walk(tree, 0, np.ones(leaf.shape, bool))
        given = values[ys, xs]
        v[ys, xs] = now = guess + factor * given if decode else given
        if not decode and ((given - guess) % factor).any():
            raise ValueError("a sample is no multiple of its leaf's multiplier from the prediction")
        out[ys, xs], reached[ys, xs] = now if decode else (given - guess) // factor, leaf
        if state:
            errors[ys, xs] = error
            state.seen(near, now)
    return out, reached, errors


def _run(samples: DataFrame, value: str, out: str, tree: tuple | Leaf, size: int, decode: bool) -> DataFrame:
    """(image_id, channel, y, x, out, leaf, error) by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = batch.column(4), batch.column(5)
            top, left = (batch.column(k).to_numpy() * size for k in (2, 3))
            counts = np.diff(places.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(counts)])
            place, value = (c.flatten().to_numpy() for c in (places, values))
            widths = np.array([place[a:b].max() % size + 1 if b > a else 0 for a, b in zip(starts[:-1], starts[1:], strict=True)])
            for width in np.unique(widths[counts > 0]):
                for count in np.unique(counts[widths == width]):
                    same = np.flatnonzero((widths == width) & (counts == count))
                    if count % width:
                        raise ValueError("tiles must be dense rectangles")
                    for lo in range(0, len(same), TOGETHER):
                        rows = same[lo : lo + TOGETHER]
                        grid = np.stack([value[starts[r] : starts[r + 1]] for r in rows], 1).reshape(count // width, width, len(rows))
                        channel, group = batch.column(1).to_numpy()[rows].astype(np.int64), top[rows] // size * 65536 + left[rows] // size
                        made = [a.reshape(count, len(rows)).T.reshape(-1) for a in lockstep(grid, tree, decode, channel, group)]
                        at, of = np.tile(np.arange(count), len(rows)), np.repeat(rows, count)
                        columns = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(top[of] + at // width), pa.array(left[of] + at % width), *map(pa.array, made)]
                        yield pa.RecordBatch.from_arrays(columns, ["image_id", "channel", "y", "x", out, "leaf", "error"])

    ready(samples.sparkSession)
    rows = tiled(samples.select("image_id", F.col("channel").cast("int").alias("channel"), "y", "x", F.col(value).cast("long").alias("v")), size)
    cells = F.array_sort(F.collect_list(F.struct((F.col("y") % size * size + F.col("x") % size).alias("p"), "v")))
    tiles = rows.groupBy("image_id", "channel", "gy", "gx").agg(cells.alias("c")).select("image_id", "channel", "gy", "gx", F.col("c.p").alias("p"), F.col("c.v").alias("v"))
    return tiles.mapInArrow(run, f"image_id string, channel int, y long, x long, {out} long, leaf long, error long")


def tree_residuals(samples: DataFrame, tree: tuple | Leaf, size: int = 128) -> DataFrame:
    """(image_id, channel, y, x, residual, leaf, error) of dense samples by tile of ``size``.

    tree: a ``Leaf``, or (property, split, left, right), left if the property lies above the split. Properties are 0 to 15 as
    in ``neighbours.properties``, with y and x inside the tile; 15 is the self-correcting predictor's error, which
    is also the column error where the tree uses it (else 0). Leaves are numbered from the left.
    """
    return _run(samples, "v", "residual", tree, size, False)


def tree_samples(residuals: DataFrame, tree: tuple | Leaf, size: int = 128) -> DataFrame:
    """(image_id, channel, y, x, v, leaf, error) of residuals made with the same tree and tiles; neighbours, properties and
    the predictor's errors are those of the samples made so far."""
    return _run(residuals, "residual", "v", tree, size, True)


def weighted_residuals(samples: DataFrame, size: int = 128) -> DataFrame:
    """(image_id, channel, y, x, residual) of the self-correcting predictor, by tile."""
    return tree_residuals(samples, Leaf(SELF_CORRECTING), size).drop("leaf", "error")


def weighted_samples(residuals: DataFrame, size: int = 128) -> DataFrame:
    """(image_id, channel, y, x, v) of residuals made with the same tiles."""
    return tree_samples(residuals, Leaf(SELF_CORRECTING), size).drop("leaf", "error")
