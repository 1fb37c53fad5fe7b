"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

Words (letters, digits, non-ASCII; A-Z lower-cased) hash to embedding rows; a word's embedding is the sum of
its own row and those of its first four and five bytes, so that unseen inflections share a stem's. Filters of several widths slide
over the whole text, each keeps its largest response, and a linear layer adds them up. Embeddings begin as
small noise beside a smoothed log-odds of the fit sample, and are trained with the filters. Scores are
calibrated (Platt) with the labels' own class shares on rows kept apart; a threshold for each language is
chosen on those rows too. Language is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, tune
from .quality import labelled_sample
from .textkernel import NOT_ALNUM, Words, hash_runs, slices

BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 12
#: The fit sample: at most so many rows with label 1 and with label 0, of texts of at most so many words.
POSITIVES, NEGATIVES, FIT_WORDS = 2_500, 5_000, 20_000
#: Smoothing of the log-odds that embeddings begin with.
SMOOTH = 3.0


#: Bytes of the prefixes that have rows of their own, beside the whole word.
PREFIXES = (4, 5)
ROWS = BUCKETS * (1 + len(PREFIXES))


def _ids(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each text: for each word the buckets of itself and of its prefixes."""
    words = Words(data, offsets, lower=True, breaks=NOT_ALNUM)
    hashes = [words.hashes, *(hash_runs(data, words.starts, np.minimum(words.ends, words.starts + n), True) for n in PREFIXES)]
    buckets = np.stack([(h >> np.uint64(33)) % np.uint64(BUCKETS) for h in hashes], 1).astype(np.uint16)
    return [buckets[words.bounds[k] : words.bounds[k + 1]] for k in range(len(offsets) - 1)]


@dataclass
class Convolution:
    embedding: np.ndarray  # ROWS + 1 rows; the last one is padding
    filters: list[np.ndarray]  # for each width: width x DIMENSIONS x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float = 0.0
    scale: float = 1.0  # of the calibration
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)  # by language

    def _laid(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts in a row, each at least one word and then padding; and where they start."""
        gap = np.full((max(WIDTHS), 1 + len(PREFIXES)), ROWS, np.int64)
        tables = np.arange(1 + len(PREFIXES)) * BUCKETS
        starts = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
        return np.concatenate([x for t in texts for x in (t + tables, gap)]), starts

    def responses(self, texts: list[np.ndarray], goes_on: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses (texts x all filters), the words, and the place of each largest one. Of a text that
        goes on, only windows wholly inside count."""
        words, starts = self._laid(texts)
        x = self.embedding[words[:, 0]]
        for k in range(1, words.shape[1]):
            x += self.embedding[words[:, k]]
        best, places = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            act = np.broadcast_to(b, (len(words) - width + 1, FILTERS)).copy()
            for j in range(width):
                act += x[j : len(words) - width + 1 + j] @ w[j]
            at = np.stack([a + act[a : max(a + 1, z - max(WIDTHS) - (width - 1) * goes_on)].argmax(0) for a, z in zip(starts[:-1], starts[1:], strict=True)])
            places.append(at)
            best.append(np.take_along_axis(act, at, 0))
        return np.maximum(np.concatenate(best, 1), 0), words, np.concatenate(places, 1)

    def margin(self, texts: list[np.ndarray]) -> np.ndarray:
        out = [np.zeros(0)]
        lo = 0
        while lo < len(texts):  # runs of texts of about 30,000 words
            hi, n = lo, 0
            while hi < len(texts) and (hi == lo or n + len(texts[hi]) < 30_000):
                n += len(texts[hi])
                hi += 1
            out.append(self._long(texts[lo]) if n > 300_000 else self.responses(texts[lo:hi])[0] @ self.out + self.offset)
            lo = hi
        return np.concatenate(out)

    def _long(self, text: np.ndarray) -> np.ndarray:
        """A very long text in overlapping pieces; the largest response of all is that of the whole.

        Each window of the whole lies inside a piece; padding follows only those that reach the text's end."""
        pieces = [text[k : k + 30_000 + max(WIDTHS) - 1] for k in range(0, len(text), 30_000)]
        return np.array([np.max([self.responses([p], 30_000 * k + len(p) < len(text))[0][0] for k, p in enumerate(pieces)], axis=0) @ self.out + self.offset])

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(texts) + self.shift, -40, 40)))


def fit_convolution(texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, seed: int = 9) -> Convolution:
    """Minibatch Adagrad on the logistic loss, the classes weighed alike."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.05, (ROWS + 1, DIMENSIONS)).astype(np.float32)
    tables = np.arange(1 + len(PREFIXES)) * BUCKETS
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(t + tables) for t, v in zip(texts, y, strict=True) if v == c)]), minlength=ROWS) for c in (0, 1)]
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    embedding[:-1, 0] = np.clip(np.log((seen[1] / n[1] * sum(n) / 2 + SMOOTH) / (seen[0] / n[0] * sum(n) / 2 + SMOOTH)), -3, 3)
    embedding[-1] = 0
    net = Convolution(embedding, [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32))
    for w in net.filters:
        w[:, 0, : FILTERS // 2] = 0.5
    if len(np.unique(y)) < 2:
        net.out[:] = 0
        return net
    squares = [np.full_like(p, 1e-4) for p in (embedding, *net.filters, *net.bias, net.out, np.zeros(1, np.float32))]
    weight = np.where(y == 1, sum(n) / 2 / n[1], sum(n) / 2 / n[0])
    k = len(WIDTHS)

    def step(p: np.ndarray, g: np.ndarray, s: np.ndarray, rate: float = 0.05) -> None:
        s += g * g
        p -= rate * g / np.sqrt(s)

    offset = np.zeros(1, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            part = order[lo : lo + 32]
            pooled, words, places = net.responses([texts[i] for i in part])
            error = ((1 / (1 + np.exp(-(pooled @ net.out + offset[0]))) - y[part]) * weight[part] / len(part)).astype(np.float32)
            back = np.outer(error, net.out) * (pooled > 0)
            step(net.out, pooled.T @ error + 1e-4 * net.out, squares[-2])
            step(offset, error.sum(keepdims=True), squares[-1])
            for f, width in enumerate(WIDTHS):
                own, at = back[:, f * FILTERS : (f + 1) * FILTERS], places[:, f * FILTERS : (f + 1) * FILTERS]
                grad = np.zeros_like(net.filters[f])
                rows, change = [], []
                for j in range(width):
                    found = words[at + j]
                    x = embedding[found].sum(-2)
                    grad[j] = np.einsum("df,dfe->ef", own, x)
                    rows.append(found.reshape(-1))
                    change.append(np.repeat((own[:, :, None] * net.filters[f][j].T[None]).reshape(-1, DIMENSIONS), found.shape[-1], 0))
                step(net.filters[f], grad + 1e-4 * net.filters[f], squares[1 + f])
                step(net.bias[f], own.sum(0), squares[1 + k + f])
                touched, place = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(touched), DIMENSIONS), np.float32)
                np.add.at(total, place, np.concatenate(change))
                total[touched == ROWS] = 0
                squares[0][touched] += total * total
                embedding[touched] -= 0.02 * total / np.sqrt(squares[0][touched])
        net.offset = float(offset[0])
    return net


def calibrate(net: Convolution, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, langs: list) -> None:
    """Platt's two numbers by Newton's method on weighted rows, then each language's threshold of best F1."""
    if len(np.unique(y)) < 2:
        return
    m = net.margin(texts)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(g * m).sum() + 0.1 * (a - 1), g.sum()])
        hess = np.array([[(h * m * m).sum() + 0.1, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    net.scale, net.shift = max(float(a), 1e-3), float(b)
    score = net.score(texts)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if (y[own] == 1).sum() < 10 or (y[own] == 0).sum() < 10:
            continue
        grid = np.linspace(0.1, 0.9, 17)
        hit = [((score[own] >= t) & (y[own] == 1)) @ weight[own] for t in grid]
        all_ = [(score[own] >= t) @ weight[own] + (y[own] == 1) @ weight[own] for t in grid]
        f1 = np.array([2 * h / max(s, 1e-9) for h, s in zip(hit, all_, strict=True)])
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        net.thresholds[lang] = float(grid[best[np.abs(grid[best] - 0.5).argmin()]])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", lang_col: str = "lang", positives: int = POSITIVES, negatives: int = NEGATIVES, text_col: str = "text") -> Convolution:
    """A network fitted on the bounded sample of rows outside fold 0; fold 4 of it calibrates. Labels of fold 0 are not even counted.

    An id that bears both labels may be drawn once as each, and then teaches both.
    """
    tune(docs.sparkSession)
    counts = {r.y: r.n for r in labels.where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, _, data, offsets in slices(batch.column(4)) for x in _ids(data, offsets)]
            keep = [k for k, x in enumerate(found) if len(x) <= FIT_WORDS]
            if keep:
                taken = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in range(4)), pa.array([found[k].tobytes() for k in keep], pa.binary())], ["doc_id", "y", "fold", "lang", "words"])

    some = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang"))
    parts = [labelled_sample(some.select(id_col, "text"), labels.where(F.col(label) == y), label, id_col, n) for y, n in ((1, positives), (0, negatives))]
    rows = parts[0].unionByName(parts[1])
    lang = some.select(F.col(id_col).alias("doc_id"), "lang").join(small(rows.select("doc_id"), positives + negatives, 16), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = rows.join(lang, "doc_id", "left").select("doc_id", "y", "fold", "lang", "text").mapInArrow(words, "doc_id long, y int, fold int, lang string, words binary")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    texts, y = [np.frombuffer(r.words, np.uint16).reshape(-1, 1 + len(PREFIXES)) for r in rows], np.array([r.y for r in rows], np.int64)
    apart = np.array([r.fold == 4 for r in rows], bool)
    net = fit_convolution([t for t, k in zip(texts, apart, strict=True) if not k], y[~apart])
    share = np.array([counts.get(int(v), 0) / max(1, int((y == v).sum())) for v in y[apart]])
    calibrate(net, [t for t, k in zip(texts, apart, strict=True) if k], y[apart], share, [r.lang for r, k in zip(rows, apart, strict=True) if k])
    return net


def score_toxicity(docs: DataFrame, net: Convolution, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, toxic) of every row.

    A null or empty text scores as padding alone. held_out: the crc32 of the id as text leaves 0 modulo 5, so
    its label was not used. predicted is 1 from ``threshold`` on; ``toxic`` from the language's own threshold
    on, 0.5 where the language is null or had too few labelled rows. Equal texts score alike; an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if batch.num_rows:
                score = np.concatenate([net.score(_ids(data, offsets)) for _, _, data, offsets in slices(batch.column(2))])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "lang", "score"])

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang string, score double")
    own = F.lit(0.5)
    for code, least in sorted(net.thresholds.items()):
        own = F.when(F.col("lang") == code, F.lit(least)).otherwise(own)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), own.alias("threshold"), (F.col("score") >= own).alias("toxic"))
