import random
import re

from tesselune.llm.neardup import near_duplicates


def brute(rows, k):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "hot " * 50)]
    base = [word() for _ in range(120)]
    for i in range(10, 70):  # a chain of small changes: near ones link, far ones do not
        base[rng.randrange(120)] = word()
        rows.append((i, " ".join(base)))
    for i in range(100, 140):  # a crowd that shares half its text
        rows.append((i, " ".join(["shared"] + [f"s{k}" for k in range(40)] + [word() for _ in range(40)])))
    rows += [(200 + i, rows[30][1]) for i in range(20)]
    rng.shuffle(rows)
    return [(*r, 7) for r in rows]


def test_equal_to_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(3)
    for words, limit, depth, block in ((4, 16, 6, 2048), (5, 3, 3, 10)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=words, node_limit=limit, depth=depth, block=block).collect()}
        assert got == brute(rows, words)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_of_near_copies_and_a_long_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(100)], []
    for i in range(900):  # copies with 0 to 12 words changed: most pairs lie below the threshold, chains join many
        text = list(base)
        for _ in range(rng.randrange(13)):
            text[rng.randrange(100)] = word()
        rows.append((i, " ".join(text)))
    long = [word() for _ in range(60_000)]
    rows += [(2000, " ".join(long)), (2001, " ".join(long[:-5])), (2002, " ".join(long[:40_000])), (2003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=4).collect()}
    assert got == brute(rows, 4)


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 2, 1, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 3


def test_sketches_rank_pairs_as_similarity_does():
    import numpy as np

    from tesselune.llm.neardup import agreement, least_agreement, signatures, sketches

    rng, least, lost = np.random.default_rng(2), least_agreement(80), 0
    for size in (5, 40, 400):
        for _ in range(300):  # pairs at 0.8: 8 of 10 parts shared
            both = rng.integers(0, 1 << 63, size * 2, dtype=np.uint64)
            one = sketches(signatures([both[: int(size * 1.8)], both[int(size * 0.2) :]])).view(np.uint64)
            lost += agreement(one[:1], one[1:])[0] < least
    assert lost == 0
    apart = sketches(signatures([rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(200)])).view(np.uint64)
    assert agreement(apart[1:], apart[:1]).max() < least


def test_words_of_thue_and_morse_are_two_words(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    rows = [(1, one), (2, other), (3, f"{one} {other}"), (4, f"{other} {one}"), (5, one.upper())]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_branching_loses_no_link(spark):
    """Nodes of more than a few odd documents branch, level after level; the rows are those of the default and of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t) for i, (_, t, *_) in enumerate(corpus(9))], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra).repartition(3)
    rows = lambda **k: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=4, **k).collect()}
    plain = rows()
    assert plain == rows(block=2, node_limit=2) == brute([tuple(r) for r in docs.collect()], 4)
