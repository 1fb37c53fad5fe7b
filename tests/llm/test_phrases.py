import random
import re
from collections import Counter

import numpy as np

from tesselune.llm.phrases import CountTrie, Filter, collocations, unpack


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    dropped = {(lang, p[i:j]) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and f[lang, p[i:j]] <= a}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in dropped:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out.sort()
    place, result = Counter(), set()
    for lang, score, a, phrase, l, r in out:
        place[lang] += 1
        if place[lang] <= top:
            result.add((lang, place[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return result


def corpus():
    rng = random.Random(6)
    fixed = ["New york city hall", "in the middle of", "é ß ü", "a a a a a a", "x\ty z"]
    words = ["the", "of", "a", "Tree", "z\x85", "in", "city"]
    rows = [(None, "en"), ("", None), ("...", "en"), ("\n\n", "de")]
    for k in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))]
        rows.append((rng.choice([". ", " ", "\r\n", "! "]).join(parts), rng.choice(["en", "de", None])))
    rows += [("und so " * 30, "und")] * 2 + [("same text here " * 40, "en")] * 3
    return rows


def test_equal_to_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, f long, path string").repartition(3)
    for least, top in ((5, 2000), (12, 7), (1000, 5)):
        out = collocations(docs, least=least, top=top)
        assert [t for _, t in out.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5
        assert {tuple(r) for r in out.collect()} == brute(rows, least, top)


def test_no_rows_and_a_very_long_text(spark):
    docs = spark.createDataFrame([("one two three four " * 60_000 + "w" * 100_000, "en")], "text string, lang string")
    assert collocations(docs.limit(0)).count() == 0
    got = {r.phrase: r.a for r in collocations(docs).collect()}
    assert got["one two three four one"] == 59_999 and got["two three four one two"] == 59_999 and got["one two three four"] == 60_000


def test_products_beyond_64_bits(spark):
    """Counts are exact: a n reaches 1e12 here, and the decimals of the plan hold 38 digits."""
    assert spark.sql("SELECT (CAST(1000 AS decimal(4,0)) * CAST(8000000000000 AS decimal(19,0)) * CAST(9000000000001 AS decimal(19,0))) div (CAST(7000000000003 AS decimal(19,0)) * CAST(11 AS decimal(19,0))) AS v").first().v == 1000 * 8000000000000 * 9000000000001 // (7000000000003 * 11)


def test_trie_and_filter(spark):
    trie, rng = CountTrie(3), np.random.default_rng(3)
    paths = rng.integers(1, 4, (500, 3)).astype(np.uint64)
    paths[::3, 2] = 0
    trie.add(paths[:300])
    trie.settle()
    trie.add(paths[300:])
    want = Counter(tuple(p[:k]) for p in paths.tolist() for k in (2, 3) if p[k - 1])
    nodes = trie.nodes(2).to_pylist()
    assert {tuple(v for v in (n["w1"], n["w2"], n["w3"]) if v): n["f"] for n in nodes} == want
    assert [(n["w1"], n["w2"], n["w3"]) for n in nodes] == sorted((n["w1"], n["w2"], n["w3"]) for n in nodes)
    trie.add(paths)
    merged = CountTrie(3)
    for piece in trie.pieces(2, 3).to_pylist():
        merged.add(*unpack(piece["trie"], 3))
        merged.add(*unpack(piece["trie"], 3))
    assert {tuple(v for v in (n["w1"], n["w2"], n["w3"]) if v): n["f"] for n in merged.nodes(2).to_pylist()} == {k: 2 * f for k, f in want.items()}
    assert merged.nodes(2).num_rows == 0 and trie.pieces(2, 3).num_rows == 0
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    held = Filter.of(spark.createDataFrame([(int(k),) for k in keys[:2000]], "key long"), 2000)
    assert held.has(keys[:2000]).all() and held.has(keys[2000:]).sum() < 100
