import random

import numpy as np
from pyspark.sql import Row

from tesselune.llm.decontam import contaminated, seeds_asked, tile


def brute(item, doc, seed):
    """Greedy string tiling: the longest common unmarked run first, until none of seed words is left."""
    item_free, doc_free, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item_free[i + n] and doc_free[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < seed:
            return total
        item_free[i : i + n], doc_free[j : j + n] = [False] * n, [False] * n
        total += n


def test_tiles_are_as_greedy_as_brute_force():
    rng = random.Random(5)
    for k in range(1500):
        letters = rng.choice([2, 3, 5, 9])
        item = [rng.randrange(letters) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(letters) for _ in range(rng.randrange(0, 30))] + (item[len(item) // 2 :] + [9] + item[: len(item) // 2] if k % 2 else [])
        found = tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        used = [p for i, _, n in found for p in range(i, i + n)], [p for _, j, n in found for p in range(j, j + n)]
        assert all(len(set(u)) == len(u) for u in used)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in found)
        assert sum(n for *_, n in found) == brute(item, doc, min(3, len(item)))


def test_seeds_asked_for_lose_no_hit():
    rng = random.Random(7)
    for _ in range(800):
        letters, seed, least = rng.choice([2, 4]), rng.randrange(1, 5), rng.choice([0.3, 0.5, 1.0])
        item, doc = ([rng.randrange(letters) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        s = min(seed, len(item))
        have = {tuple(doc[j : j + s]) for j in range(len(doc) - s + 1)}
        places = sum(tuple(item[i : i + s]) in have for i in range(len(item) - s + 1))
        if brute(item, doc, s) >= least * len(item):
            assert places >= seeds_asked(len(item), seed, least)


def test_both_routes_give_rows_of_null_and_repeated_ids(spark):
    leak, other = (" ".join(f"{x}{k}" for k in range(30)) for x in "wv")
    docs = [(None, leak), (None, leak), (None, "clean text of some words"), (4, leak), (4, leak + " " + other), (4, "clean"), (None, None), (9, other)]
    items = [(None, leak), (1, leak), (1, other), (None, ""), (2, None)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item long").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc long")
    one, two = (sorted(map(str, contaminated(d, b, broadcast_chars=chars).collect())) for chars in (1 << 20, 0))
    assert one == two and len(one) == 10
    assert one == sorted(str(Row(doc_id=i, item_id=k, item_words=30, tiles=1, covered=30, coverage=1.0)) for i, t in docs for k, x in items if t and x and x in t)


def test_passages_are_found_and_clean_documents_left_alone(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words), "x"), (2, None, "x"), (3, "", "x"), (4, "tiny item", "x"), (5, " ".join(words), "x")]
    docs = [
        (10, "before " + " ".join(words) + " after", 0),
        (11, "Before, " + ", ".join(w.upper() for w in words) + "!", 0),
        (12, " ".join(words[20:]) + " gap " + " ".join(words[:20]), 0),
        (13, " ".join(words[:12]), 0),
        (14, None, 0),
        (15, "", 0),
        (16, "a tiny item here", 0),
        (17, "nothing of that kind " * 200, 0),
        (18, "filler " * 30_000 + " ".join(words), 0),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, hash int")
    b = spark.createDataFrame(items, "item_id long, text string, hash string")
    for chars in (1 << 20, 0):
        got = {(r.doc_id, r.item_id): (r.tiles, r.covered) for r in contaminated(d, b, broadcast_chars=chars).collect()}
        assert set(got) == {(i, k) for i in (10, 11, 12, 18) for k in (1, 5)} | {(16, 4)}
        assert got[10, 1] == (1, 40) and got[12, 1] == (2, 40)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some benchmark item of words")], "item_id long, text string")
    assert contaminated(d, b).count() == 0
    full = spark.createDataFrame([(1, "some benchmark item of words")], "doc_id long, text string")
    assert contaminated(full, b.limit(0)).count() == 0 and contaminated(full, b).count() == 1
