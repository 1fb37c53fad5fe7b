import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselune.llm.quality import BUCKETS, DIMENSIONS, FEATURES, NEIGHBOURS, _buckets, _context_sums, _pooled, fit_network, fit_quality, fit_temperature, index_vectors, labelled_sample, score_quality
from tesselune.llm.textkernel import slices
from tesselune.llm.toxicity import DIMENSIONS as EMBEDDED
from tesselune.llm.toxicity import FILTERS, ROWS, WIDTHS, Convolution, fit_convolution, fit_toxicity, score_toxicity


def corpus(spark, n=600):
    rng = random.Random(2)
    syllables = ["ta", "ke", "mi", "lo", "sun", "ra", "vel", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumpf" + rng.choice(["", "en", "ish"]))
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), 0.5))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(n, None, "en", 0.5), (n + 1, "", None, 0.5), (n + 2, " \n\t", "en", 0.5), (n + 3, "word " * 400_000, "en", 0.5)]
    labels += [(n, None, None), (n + 1, 1, 0), (None, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: (q, t) for i, q, t in labels if i is not None and q is not None},
    )


def checked(rows, truth, which):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    return np.mean([r.predicted == truth[r.doc_id][which] for r in held])


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    rows = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert checked(rows, truth, 0) > 0.95
    again = score_quality(docs.repartition(5), fit_quality(docs.repartition(5), labels)).collect()
    assert {r.doc_id: round(r.score, 6) for r in rows} == {r.doc_id: round(r.score, 6) for r in again}
    kept = score_quality(docs, fit_quality(docs, labels), carry=True)
    assert kept.columns == ["row", "held_out", "score", "predicted"] and kept.select("row.*").columns == docs.columns
    carried = {r.doc_id: (r.own, round(r.score, 9)) for r in kept.select("row.doc_id", F.col("row.score").alias("own"), "score").collect()}
    assert carried == {r.doc_id: (0.5, round(r.score, 9)) for r in rows}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    net = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, net).collect()
    assert len(rows) == docs.count()
    assert checked(rows, truth, 1) > 0.95
    assert set(net.thresholds) <= {"en", "de"} and net.thresholds
    for r in rows:
        assert r.toxic == (r.score >= r.threshold) and r.predicted == int(r.score >= 0.5)
    assert score_toxicity(docs.drop("lang"), net).count() == len(rows)


def test_held_out_labels_reach_no_score(spark):
    docs, labels, _ = corpus(spark, 400)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    turned = labels.withColumn("toxic", F.when(held, F.lit(1)).otherwise(F.col("toxic")))
    a, b = fit_toxicity(docs, labels), fit_toxicity(docs, turned)
    assert (a.scale, a.shift, a.offset, a.thresholds) == (b.scale, b.shift, b.offset, b.thresholds)


@pytest.mark.parametrize("empty", ["docs", "labels"])
def test_nothing_to_learn_from(spark, empty):
    docs, labels, _ = corpus(spark, 20)
    docs, labels = (docs.limit(0) if empty == "docs" else docs), (labels.limit(0) if empty == "labels" else labels)
    assert score_quality(docs, fit_quality(docs, labels)).count() == docs.count()
    assert score_toxicity(docs, fit_toxicity(docs, labels)).count() == docs.count()


def test_long_texts_in_pieces_are_scored_as_a_whole():
    rng = np.random.default_rng(1)
    net = fit_convolution([rng.integers(0, 30000, (20, 3)).astype(np.uint16) for _ in range(40)], np.arange(40) % 2, epochs=1)
    text = rng.integers(0, 30000, (70_000, 3)).astype(np.uint16)
    assert isinstance(net, Convolution) and len(net.embedding) == ROWS + 1
    assert net._long(text)[0] == pytest.approx((net.responses([text])[0] @ net.out + net.offset)[0], rel=1e-4)


def test_pieces_add_no_padding():
    rng = np.random.default_rng(3)
    net = fit_convolution([rng.integers(0, 30000, (20, 3)).astype(np.uint16) for _ in range(40)], np.arange(40) % 2, epochs=1)
    for w, b in zip(net.filters, net.bias, strict=True):  # a response only where padding follows a word
        w[:], b[:] = -1, 1
    net.embedding[:-1] = 0
    net.embedding[:-1, 0] = np.where(np.arange(ROWS) % 2, 1, 0.3)
    net.out[:] = np.arange(1, len(net.out) + 1)
    for n in (59_999, 60_000, 60_001, 60_002, 60_003, 70_000):
        text = rng.integers(0, 15000, (n, 3)).astype(np.uint16) * 2 + 1
        for k in (30_000, 60_000):
            text[min(k + 1, n - 1)] = 0
        assert net._long(text)[0] == pytest.approx((net.responses([text])[0] @ net.out + net.offset)[0], rel=1e-6), n


def test_network_and_temperature():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, FEATURES))
    apart = np.arange(900) % 5 == 0
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no single layer can tell
    assert np.mean((fit_network(x, y, apart).score(x[~apart]) > 0.5) == y[~apart]) > 0.95
    x[:, :10] += rng.normal(size=(900, 1))  # ten columns tell of one thing
    y = (x[:, :10].mean(1) > 0).astype(int)
    assert np.mean((fit_network(x, y, apart).score(x[apart]) > 0.5) == y[apart]) > 0.85
    margin = rng.normal(size=4000)
    drawn = rng.random(4000) < 1 / (1 + np.exp(-margin))
    assert fit_temperature(3 * margin, drawn.astype(int)) == pytest.approx(3, rel=0.15)
    assert fit_temperature(margin, np.ones(4000, int)) == 1


def test_context_sums_and_pooling_equal_plain_loops():
    texts = pa.array(["a b, c! a", None, "", "zeta " * 7 + "b", "one", "two words", "a b c d e f g h i"])
    docs = []
    for _, _, data, offsets in slices(texts):
        buckets, bounds = _buckets(data, offsets)
        docs += [buckets[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    places, sums = index_vectors(), np.zeros((BUCKETS, DIMENSIONS))
    for words in docs:
        for i, w in enumerate(words):
            for near in words[max(0, i - NEIGHBOURS) : i + NEIGHBOURS + 1]:
                for k, at in enumerate(places[near]):
                    sums[w, at] += 1 - 2 * (k % 2)
    got = np.zeros_like(sums)
    for batch in _context_sums(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            part = np.frombuffer(blob, "<i8").reshape(-1, DIMENSIONS)
            got[block * len(part) : (block + 1) * len(part)] += part
    assert np.array_equal(got, sums)
    vectors = np.random.default_rng(6).normal(size=(BUCKETS, DIMENSIONS)).astype(np.float32)
    pooled = _pooled(texts, vectors)
    for words, row in zip(docs, pooled, strict=True):
        want = np.zeros(FEATURES)
        if words:
            v = vectors[words].astype(np.float64)
            likeness = [sum(v[i] @ v[i - far] for i in range(far, len(v))) / len(v) for far in (1, 2)]
            want = np.concatenate([v.mean(0), v.std(0), [np.linalg.norm(v.mean(0)), *likeness, np.log1p(len(v)) / 10]])
        assert np.allclose(row, want, atol=2e-3)  # spreads are differences of squares in float32


def test_responses_equal_plain_loops():
    rng = np.random.default_rng(5)
    net = fit_convolution([rng.integers(0, 30000, (20, 3)).astype(np.uint16) for _ in range(40)], np.arange(40) % 2, epochs=1)
    texts = [rng.integers(0, 30000, (n, 3)).astype(np.uint16) for n in (0, 1, 2, 5, 40)]
    got = net.responses(texts)[0]
    for t, row in zip(texts, got, strict=True):
        vectors = [sum(net.embedding[int(b) + k * (ROWS // 3)] for k, b in enumerate(w)) for w in t] + [np.zeros(EMBEDDED)] * max(WIDTHS)
        at = 0
        for width, w, b in zip(WIDTHS, net.filters, net.bias, strict=True):
            for f in range(FILTERS):
                best = max(b[f] + sum(vectors[i + j] @ w[j, :, f] for j in range(width)) for i in range(max(1, len(t))))
                assert row[at] == pytest.approx(max(best, 0), abs=1e-4)
                at += 1


def test_the_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "x"), (3, None)] * 4, "doc_id long, body string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.text for r in labelled_sample(docs, labels, "quality", "doc_id", 100, "body").collect()}
    assert got == {i: t for i, t in ((1, "a"), (2, "c"), (3, None)) if zlib.crc32(str(i).encode()) % 5}
