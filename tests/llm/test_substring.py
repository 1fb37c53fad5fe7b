import hashlib
import random
import re

import pytest

from tesselune.llm.substring import difference_cover, repeated_passages


@pytest.mark.parametrize("period", [1, 2, 3, 5, 7, 10, 13, 21, 31, 40])
def test_cover_has_each_difference(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute(rows, width):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    passage = [[rng.choice("abcdefgh") for _ in range(20)] for _ in range(3)]
    rows = [(0, None, 1), (1, "", 1), (2, "a b c", 1), (3, " \t\n", 1)]
    for i in range(4, 60):
        words = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passage)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), 1))
    rows += [(100, rows[10][1], 1), (101, rows[10][1], 1), (102, "é\x85x " * 30, 1), (103, "é\x85x " * 40, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int").repartition(4)
    for width, period in ((8, 7), (5, 3), (4, 9)):
        got = {r.doc_id: tuple(r)[1:] for r in repeated_passages(docs, width=width, period=period, with_text=True).collect()}
        assert got == brute(rows, width)


def test_null_ids_stay_whole(spark):
    long = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(None, long), (2**60 + 1, long), (2**60 + 2, long), (None, long), (None, "x y")], "doc_id long, text string").coalesce(1)
    out = repeated_passages(docs, width=8, period=7)
    assert dict(out.dtypes)["doc_id"] == "bigint"
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in out.collect()), key=str) == sorted([(None, 20, 0), (None, 20, 0), (None, 2, 0), (2**60 + 1, 20, 0), (2**60 + 2, 20, 20)], key=str)


def test_no_rows(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_thue_and_morse_are_two_words(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    order = [0]
    for _ in range(6):
        order += [1 - x for x in order]
    rows = [(1, "w " * 49 + one, 1), (2, "w " * 49 + other, 1), (3, " ".join(("x", "y")[k] for k in order), 1), (4, " ".join(("y", "x")[k] for k in order), 1), (5, "w " * 49 + one, 1)]
    got = {r.doc_id: r.n_removed for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, hash int")).collect()}
    assert got == {i: v[1] for i, v in brute(rows, 50).items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 50}


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(2, " ".join(long), 0), (1, " ".join(long[70_000:70_200]), 0)]
    got = {r.doc_id: r.n_removed for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, hash int")).collect()}
    assert got == {1: 0, 2: 200}
