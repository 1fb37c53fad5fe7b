"""Document quality: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Random indexing (Kanerva, Kristofersson and Holst 2000): every word bucket has a sparse index vector by
hashing; a bucket's vector is the sum of the index vectors of itself and of its neighbours over the whole
corpus, so words never labelled are placed by their company. The sums are of a fixed size whatever the
corpus: partitions add up their own, and two shuffles merge them. A document is the mean and the spread of its
words' unit vectors. The network is fitted by numpy on a bounded sample of labelled rows; a temperature,
fitted on rows kept apart, makes its outputs probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, tune
from .textkernel import NOT_ALNUM, Words, slices, stream

BUCKETS, DIMENSIONS, NONZERO, NEIGHBOURS = 1 << 14, 48, 3, 2
FEATURES = 2 * DIMENSIONS + 4
#: Rows of the sums that one message carries, and first-level merges of a block.
BLOCK, MERGES = 512, 64
#: At most so many labelled rows are fitted.
SAMPLE = 20_000


def index_vectors() -> np.ndarray:
    """For each bucket the places of its nonzero entries; the first is +1, the others alternate in sign."""
    return (stream(404, BUCKETS * NONZERO) % np.uint64(DIMENSIONS)).astype(np.int64).reshape(BUCKETS, NONZERO)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word or run of punctuation, and the documents' bounds."""
    words = Words(data, offsets, breaks=NOT_ALNUM, marks=True)
    return (words.hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, words.bounds


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, sums = index_vectors(), np.zeros(BUCKETS * DIMENSIONS)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            buckets, bounds = _buckets(data, offsets)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for far in range(NEIGHBOURS + 1):
                a, b = buckets[far:], buckets[: len(buckets) - far]
                inside = doc[far:] == doc[: len(doc) - far]
                a, b = a[inside], b[inside]
                for word, near in ((a, b), (b, a))[: 1 + (far > 0)]:
                    for k in range(NONZERO):
                        sums += (1 - 2 * (k % 2)) * np.bincount(word * DIMENSIONS + places[near, k], minlength=len(sums))
    sums = sums.reshape(BUCKETS, DIMENSIONS)
    salt = int(np.abs(sums[:, 0]).sum()) % MERGES
    for k in range(0, BUCKETS, BLOCK):
        if sums[k : k + BLOCK].any():
            yield pa.RecordBatch.from_pydict({"block": [k // BLOCK], "salt": [salt], "sums": [sums[k : k + BLOCK].astype("<i8").tobytes()]})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of the blocks of a partition."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, salt, blob in zip(*batch.columns, strict=True):
            key, sums = (block.as_py(), salt.as_py()), np.frombuffer(blob.as_buffer(), "<i8")
            held[key] = held[key] + sums if key in held else sums.copy()
    for (block, salt), sums in held.items():
        yield pa.RecordBatch.from_pydict({"block": [block], "salt": [salt], "sums": [sums.tobytes()]})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of the buckets over all documents; of a size fixed by ``BUCKETS`` and ``DIMENSIONS``."""
    schema = "block long, salt long, sums binary"
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_sums, schema)
    parts = parts.repartition("block", "salt").mapInArrow(_added, schema)
    parts = parts.withColumn("salt", F.lit(0).cast("long")).repartition("block").mapInArrow(_added, schema)
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in parts.collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.sums, "<i8").reshape(-1, DIMENSIONS)
    out[:, :] /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def _pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Zeros without words; else mean and standard deviation of the words' vectors, the length of the mean,
    how like neighbours and next neighbours are on average, and the log of the words' number."""
    rows = []
    for _, _, data, offsets in slices(column, 1 << 18):
        buckets, bounds = _buckets(data, offsets)
        out = np.zeros((len(bounds) - 1, FEATURES), np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            found, n = vectors[buckets], np.diff(bounds)[full][:, None]
            mean = np.add.reduceat(found, bounds[full], axis=0) / n
            square = np.add.reduceat(found * found, bounds[full], axis=0) / n
            likeness = []
            for far in (1, 2):
                near = np.zeros(len(found), np.float32)
                near[far:] = np.einsum("ij,ij->i", found[far:], found[:-far])
                for k in range(far):
                    near[np.minimum(bounds[full] + k, bounds[full + 1] - 1)] = 0  # their neighbours are in the text before
                likeness.append(np.add.reduceat(near, bounds[full])[:, None] / n)
            length = np.linalg.norm(mean, axis=1, keepdims=True)
            out[full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), length, *likeness, np.log1p(n) / 10], axis=1)
        rows.append(out)
    return np.concatenate(rows)


@dataclass
class Network:
    """Two layers over scaled features, and the temperature that divides the output."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.centre) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the logistic loss with weight decay; rows marked ``apart`` fit the temperature only."""
    rng = np.random.default_rng(seed)
    fx, fy = x[~apart], y[~apart].astype(np.float64)
    if not len(fx):
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), 0.0)
    net = Network(fx.mean(0), fx.std(0) + 1e-3, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    scaled = (fx - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs)
        order = rng.permutation(len(fx))
        for lo in range(0, len(fx), 256):
            part = order[lo : lo + 256]
            h = np.maximum(scaled[part] @ params[0] + params[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - fy[part]) / len(part)
            back = np.outer(error, params[2]) * (h > 0)
            grads = [scaled[part].T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    net.temperature = fit_temperature(net.margin(x[apart]), y[apart])
    return net


def fit_temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, on a grid of even ratios; 1 without rows of both labels."""
    if len(np.unique(y)) < 2:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    sign = np.where(y > 0, 1, -1)
    return float(grid[np.argmin([np.logaddexp(0, -sign * margin / t).mean() for t in grid])])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, most: int, text_col: str = "text") -> DataFrame:
    """(doc_id, y, fold, text) of at most ``most`` labelled ids outside fold 0, first by a hash of their id.

    One row an id: of rows that repeat an id the least text counts, and of repeated labels any one.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)).cast("int")
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"), fold.alias("fold"))
    rows = rows.where("fold <> 0").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(small(rows, most, 32), "doc_id").groupBy("doc_id", "y", "fold").agg(F.min("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE, text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and a network fitted on at most ``sample`` labelled rows outside fold 0."""
    tune(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pooled = _pooled(batch.column(3), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in pooled], pa.binary())], ["doc_id", "y", "fold", "x"])

    rows = labelled_sample(docs, labels, label, id_col, sample, text_col).select("doc_id", "y", "fold", "text").mapInArrow(features, "doc_id long, y int, fold int, x binary")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    shared.destroy()
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, FEATURES).astype(np.float64)
    y, fold = np.array([r.y for r in rows], np.int64), np.array([r.fold for r in rows], np.int64)
    return vectors, fit_network(x, y, fold == 4)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; with ``carry``, row, a struct of all columns of docs, for doc_id.

    A null or empty text has no words and gets the score of a document of zeros. held_out: the crc32 of the
    id as text leaves 0 modulo 5, so its label was not used. predicted is 1 from ``threshold`` on. Equal
    texts score alike; an empty table gives no rows. Other columns are ignored, or carried
    in row whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.struct(*docs.columns).alias("row")] * carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            if batch.num_rows:
                score = net.score(_pooled(batch.column(1), vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(2)] if carry else []), pa.array(score)], ["doc_id", *["row"] * carry, "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField("row", docs.schema)] * carry, T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(run, schema)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("row" if carry else "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
