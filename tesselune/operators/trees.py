"""Decision trees over the properties of samples, learned so that the tokens of each leaf cost least by entropy.

The driver holds the tree; samples stay a table. A round tells for all leaves that may be split next, and for each
property, what every threshold would gain: one pass over the samples, counted by (leaf, property, value, token).
Splits follow best first: of all leaves always the one whose best split gains most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselune.storage import remove, shared_dir, stored


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0)


def best_cuts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, threshold, bits, below, above, whole) of rows (keys, value, token, n): where to cut each key's values.

    bits is what the tokens of both sides, value <= threshold and above, cost by entropy: N log N less the sum of
    c log c; below and above are the sides' own, whole the cost without a cut. The least bits win, then the smaller
    threshold; costs are compared to six decimals. A key of one value has no threshold. Rows are counted by
    (value, token) first, so windows hold as many rows as a key has values and tokens, not as it has samples.
    """
    counts = rows.groupBy(*keys, "value", "token").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys, "token").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys, "token").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.select(*keys, "value", "n", *[(_weight(c) - _weight(c - F.col("n"))).alias(a) for c, a in ((F.sum("n").over(up), "l"), (F.sum("n").over(down), "r"))])
    at = steps.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    left = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy(*keys).orderBy("value").rowsBetween(1, Window.unboundedFollowing)
    sides = at.select(*keys, "value", *[F.sum(c).over(w).alias(a) for c, w, a in (("n", left, "nl"), ("l", left, "sl"), ("n", right, "nr"), ("r", right, "sr"))])
    below, above = F.round(_weight(F.col("nl")) - F.col("sl"), 6), F.round(_weight(F.col("nr")) - F.col("sr"), 6)
    sides = sides.select(*keys, "value", below.alias("below"), F.when(F.col("nr").isNotNull(), above).alias("above"))
    cut = F.when(F.col("above").isNotNull(), F.struct(F.round(F.col("below") + F.col("above"), 6).alias("bits"), F.col("value").alias("threshold"), "below", "above"))
    out = sides.groupBy(*keys).agg(F.min(cut).alias("best"), F.max(F.when(F.col("above").isNull(), F.col("below"))).alias("whole"))
    return out.select(*keys, "best.threshold", "best.bits", "best.below", "best.above", "whole")


@dataclass
class Node:
    """A leaf with its best split, if it has one, or a decision: left holds the samples above the threshold."""

    best: tuple[float, str, int] | None = None
    left: Node | None = None
    right: Node | None = None
    known: bool = False

    def decision(self, numbers: dict[int, int]) -> Column:
        """The number of the leaf that a row reaches; null for leaves without one."""
        if self.left is None:
            return F.lit(numbers.get(id(self)))
        _, prop, threshold = self.best
        return F.when(F.col(prop) > threshold, self.left.decision(numbers)).otherwise(self.right.decision(numbers))


def _looked_up(rows: DataFrame, root: Node, asked: list[Node], props: Sequence[str]) -> None:
    """Gives the asked leaves their best splits, by one pass over the rows."""
    leaf = root.decision({id(node): k for k, node in enumerate(asked)}).cast("int")
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.col(p).cast("long").alias("value")) for k, p in enumerate(props))))
    found = rows.select(leaf.alias("leaf"), "token", values.alias("v")).where("leaf IS NOT NULL").select("leaf", "v.rank", "v.value", "token", F.lit(1).cast("long").alias("n"))
    cuts = best_cuts(found, "leaf", "rank").where("threshold IS NOT NULL")
    best = cuts.groupBy("leaf").agg(F.min(F.struct("bits", "rank", "threshold", "whole")).alias("b"))
    for node in asked:
        node.known = True
    for r in best.select("leaf", "b.*").collect():  # a row a leaf
        asked[r.leaf].best = (round(r.whole - r.bits, 6), props[r.rank], r.threshold)


def learn_tree(rows: DataFrame, props: Sequence[str], max_leaves: int = 16, min_gain: float = 32.0) -> Node:
    """The tree over ``props``, columns of whole numbers, that best-first splits of the tokens make.

    A split must gain more bits than ``min_gain``; of equal gains the leaf that is older goes first, of equal splits of
    a leaf the earlier property and then the smaller threshold. Leaves number ``max_leaves`` at most. A round asks for
    the children of all leaves that the remaining splits can reach, so there are about as many rounds as the tree has
    levels. Null properties are not above any threshold. No rows, or none worth a split, give a single leaf.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    rows = stored(rows.select(*props, "token"), path)
    root = Node()
    _looked_up(rows, root, [root], props)
    leaves, wanted = [root], lambda n: n.best is not None and n.best[0] > min_gain
    while len(leaves) < max_leaves:
        open_ = [n for n in leaves if wanted(n)]
        if not open_:
            break
        node = max(open_, key=lambda n: n.best[0])  # the first of equals
        if node.left is None:
            node.left, node.right = Node(), Node()
        if not node.left.known:  # ask for it and for what may be split after it
            near = sorted(open_, key=lambda n: -n.best[0])[: max_leaves - len(leaves)]
            for n in near:
                n.left, n.right = n.left or Node(), n.right or Node()
            _looked_up(rows, root, [c for n in near for c in (n.left, n.right) if not c.known], props)
        leaves.remove(node)
        leaves += [node.left, node.right]
    _pruned(root, {id(n) for n in leaves})
    remove(spark, path)
    return root


def _pruned(node: Node, leaves: set[int]) -> None:
    if id(node) in leaves:
        node.left = node.right = None
    elif node.left is not None:
        _pruned(node.left, leaves)
        _pruned(node.right, leaves)


def numbered(root: Node) -> list[Node]:
    """All nodes, level by level, left before right; a decision's children come next in line."""
    out = [root]
    for node in out:
        if node.left is not None:
            out += [node.left, node.right]
    return out


def tree_table(spark: SparkSession, root: Node) -> DataFrame:
    """(node, property, split, left_child, right_child, leaf) by number; a leaf has its own number and nulls."""
    nodes = numbered(root)
    at, leaf, rows = {id(n): k for k, n in enumerate(nodes)}, 0, []
    for k, n in enumerate(nodes):
        if n.left is None:
            rows.append((k, None, None, None, None, leaf))
            leaf += 1
        else:
            rows.append((k, n.best[1], n.best[2], at[id(n.left)], at[id(n.right)], None))
    return spark.createDataFrame(rows, "node long, property string, split long, left_child long, right_child long, leaf long")


def contexts(root: Node) -> Column:
    """The leaf's number for a row with the tree's properties."""
    leaves = [n for n in numbered(root) if n.left is None]
    return root.decision({id(n): k for k, n in enumerate(leaves)}).cast("long")


def learned_thresholds(rows: DataFrame, value: str, depth: int = 3) -> list[list[int]]:
    """Sets of 1, 3, 7, ... thresholds of a value: each range of the set before is cut where its tokens cost least.

    A level ends the search if a range holds a single value, or if thresholds do not ascend. No rows give no set.
    """
    rows = rows.groupBy(F.col(value).cast("long").alias("value"), "token").agg(F.count("*").alias("n"))
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    rows = stored(rows, path)
    sets: list[list[int]] = []
    for level in range(depth):
        known = sets[-1] if sets else []
        above = F.size(F.filter(F.array(*map(F.lit, known)), lambda t: t < F.col("value"))) if known else F.lit(0)
        found = best_cuts(rows.withColumn("range", above), "range").where("threshold IS NOT NULL").collect()  # a row a range
        if len(found) < 2**level:
            break
        thresholds = sorted(known + [r.threshold for r in found])
        sets.append(thresholds)
    remove(spark, path)
    return sets
