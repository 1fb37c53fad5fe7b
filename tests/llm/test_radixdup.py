import hashlib
import random

import numpy as np
import pytest

from tesselune.llm.radixdup import equal_groups, repeated_bytes


def brute(rows, width):
    texts = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - width + 1):
            first.setdefault(texts[i][k : k + width], i)
    out = {}
    for i, t in texts.items():
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 60))) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "ab"), (3, "é" * 40)]
    for i in range(4, 90):
        text = "".join(rng.choice("abc" if i % 3 else "abcdefgh éß") for _ in range(rng.randrange(90)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passage) + text[at:]
        rows.append((i, text))
    rows += [(200, rows[10][1]), (201, rows[10][1]), (202, "a" * 500), (203, "a" * 300 + "b"), (204, "ab" * 200), (205, "é" * 30), (206, "x" * 400)]
    return [(*r, 7, 1) for r in rows]


@pytest.mark.parametrize(("width", "seed", "crowd"), [(12, 5, 8192), (8, 8, 3), (20, 7, 2), (5, 2, 8192), (50, 20, 1)])
def test_equal_to_brute_force(spark, width, seed, crowd):
    rows = corpus(width)
    docs = spark.createDataFrame(rows, "doc_id long, text string, digit int, key long").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in repeated_bytes(docs, width=width, seed=seed, crowd=crowd, with_bytes=True).collect()}
    assert {i: (*v[:4], bytes(v[4])) for i, v in got.items()} == brute(rows, width)


def test_groups_are_those_of_equal_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    for width in (3, 8, 11, 21):
        starts = np.arange(len(data) - width + 1)
        kept, begins = equal_groups(data, starts, starts // 1000, width)
        got = sorted(sorted(starts[g].tolist()) for g in np.split(kept, begins[1:]) if len(g))
        want = {}
        for s in starts.tolist():
            want.setdefault((s // 1000, data[s : s + width].tobytes()), []).append(s)
        assert got == sorted(g for g in want.values() if len(g) > 1)


def test_null_ids_empty_table_and_a_very_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1_500_000))
    rows = [(None, long[:100]), (None, long[:100]), (7, long), (8, "!" + long[1_000_000:1_000_060] + "?" + long[:49]), (2**60, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeated_bytes(docs).collect()))
    assert got == [(0, 100, 0, 0), (0, 100, 0, 0), (7, 1_500_000, 0, 0), (8, 111, 60, 1), (2**60, 1_500_000, 1_500_000, 1)]
    assert repeated_bytes(docs.limit(0)).count() == 0
