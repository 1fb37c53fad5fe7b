import math
import random

from tesselune.operators import trees


def cost(tokens):
    total = len(tokens)
    return total * math.log2(total) - sum(c * math.log2(c) for c in (tokens.count(t) for t in set(tokens))) if total > 1 else 0.0


def best(rows, props):
    out = None
    for p in props:
        for t in sorted({r[p] for r in rows})[:-1]:
            gain = cost([r["token"] for r in rows]) - cost([r["token"] for r in rows if r[p] <= t]) - cost([r["token"] for r in rows if r[p] > t])
            if out is None or gain > out[0] + 1e-7:
                out = gain, p, t
    return out


def brute(rows, props, most, least):
    """Leaves split one at a time, each evaluated by itself."""
    root = [rows, None, None]
    leaves = [root]
    while len(leaves) < most:
        found = [(b, k) for k, leaf in enumerate(leaves) if (b := best(leaf[0], props)) and b[0] > least]
        if not found:
            break
        b, k = max(found, key=lambda f: (round(f[0][0], 6), -f[1]))
        leaf = leaves.pop(k)
        leaf[1] = b[1:]
        leaf[2] = [[r for r in leaf[0] if r[b[1]] > b[2]], None, None], [[r for r in leaf[0] if r[b[1]] <= b[2]], None, None]
        leaves += leaf[2]
    nodes, out = [root], []
    for n in nodes:
        if n[2]:
            out.append((*n[1], len(nodes), len(nodes) + 1))
            nodes += n[2]
        else:
            out.append(sorted(r["i"] for r in n[0]))
    return out


def test_tree_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        a, b, c = rng.randrange(12), rng.randrange(-20, 20), rng.randrange(3)
        rows.append({"a": a, "b": b, "c": c, "token": rng.choice([0, 1, 2]) + (3 if a > 6 else 0) + (5 if b > 3 and c == 1 else 0) + (2 if a < 2 and b < -9 else 0), "i": i})
    df = spark.createDataFrame(rows, "a int, b int, c int, token int, i int")
    for most, least in ((1, 1.0), (2, 1.0), (6, 1.0), (40, 12.0), (5, 1e9)):
        tree = trees.learn_tree(df, ("a", "b", "c"), most, least)
        want = brute(rows, ("a", "b", "c"), most, least)
        table = {r.node: r for r in trees.tree_table(spark, tree).collect()}
        by_leaf = {}
        for r in df.select("i", trees.contexts(tree).alias("leaf")).collect():
            by_leaf.setdefault(r.leaf, []).append(r.i)
        assert len(table) == len(want)
        for k, w in enumerate(want):
            r = table[k]
            if isinstance(w, list):
                assert r.property is None and sorted(by_leaf[r.leaf]) == w
            else:
                assert (r.property, r.split, r.left_child, r.right_child) == w


def test_thresholds_and_empty_rows(spark):
    rng = random.Random(2)
    rows = [(v, (v // 8 + rng.randrange(2))) for v in range(64) for _ in range(6)]
    df = spark.createDataFrame(rows, "v int, token int")
    sets = trees.learned_thresholds(df, "v")
    assert [len(s) for s in sets] == [1, 3, 7] and all(s == sorted(set(s)) for s in sets)
    dicts = [{"v": v, "token": t} for v, t in rows]
    cut = best(dicts, ["v"])[2]
    assert sets[0] == [cut] and sets[1] == sorted([cut, best([r for r in dicts if r["v"] <= cut], ["v"])[2], best([r for r in dicts if r["v"] > cut], ["v"])[2]])
    assert trees.learned_thresholds(df.limit(0), "v") == []
    assert trees.learned_thresholds(df.where("v = 1"), "v") == []
    assert [len(s) for s in trees.learned_thresholds(df.where("v < 3"), "v")] == [1]
    assert trees.tree_table(spark, trees.learn_tree(df.limit(0), ("v",))).collect()[0].leaf == 0
