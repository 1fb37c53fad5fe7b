"""Near duplicates by a chosen-path similarity join over MinHash signatures.

Documents with one and the same shingle set are one class; the classes' least documents go into ``trees``
independent trees. At the root of a tree one signature coordinate splits them into nodes by its minwise token.

1. Members of a node are compared with two hubs, drawn by a hash so that each node has others, by sketch: 2 bits
   of each of 256 coordinates. Each document asks its likeliest hub of all its nodes, one candidate a document,
   and candidates are confirmed on full sets. What verified links join needs no more comparing.
2. Candidates, confirmed or not, also join documents to clusters. In a node still mixed, documents outside its
   largest component (the odd ones) are compared with all others by sketch. What goes out is (odd document,
   cluster in which it has a likely partner): never the pairs.
3. A cluster is dealt in blocks of bounded size with the full sets of its members and of the documents that ask
   for it, and all likely pairs that are not joined yet are compared exactly there. Only links come out.
4. A node with more than ``block`` odd documents branches instead: one further coordinate, or by chance a second
   (1/0.8 = 1.25 on average), chosen by the node's own hash. Those too large at the last depth take steps 2
   and 3 in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, small, tune
from .components import LABEL_BYTES, components
from .textkernel import Words, mix, slices, stream, windows

#: Signature coordinates, and the first of them, whose tokens choose the nodes.
COORDINATES, TOKENS = 256, 64
#: Shingles of a block of a cluster's members, and of those that ask.
BLOCK_SHINGLES = 1 << 18
#: Bytes of a sketch with its keys in a broadcast, as it is built.
SIGNED_BYTES = 256
#: Candidates whose sketches agree in so many standard deviations less than those of a pair at the threshold are not read.
DEVIATIONS = 5


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes)."""
    for lo, _, data, offsets in slices(batch.column(1)):
        words = Words(data, offsets, lower=True)
        for i in range(len(offsets) - 1):
            own = words.of(i)
            yield lo + i, np.unique(windows(own, min(k, max(1, len(own)))))


def least_agreement(percent: int) -> int:
    """Equal places of two sketches below which a pair is not taken for likely."""
    p = percent / 100 + (1 - percent / 100) / 4  # two bits agree by chance once in four
    return int(COORDINATES * p - DEVIATIONS * np.sqrt(COORDINATES * p * (1 - p)))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal places of sketches, given as rows of uint64."""
    differ = x ^ y
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return COORDINATES - np.bitwise_count(differ).sum(-1, dtype=np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of shingle sets, none of them empty."""
    keys, factors = stream(101, COORDINATES).astype(np.uint32), stream(202, COORDINATES).astype(np.uint32) | np.uint32(1)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    flat, done = (flat >> np.uint64(32)).astype(np.uint32), 0
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for lo in range(0, len(sets)):  # runs of documents of about 64k shingles
        if lo and starts[lo] < done:
            continue
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 65536)))
        done = starts[hi] if hi < len(sets) else len(flat)
        part, at = flat[starts[lo] : done], starts[lo:hi] - starts[lo]
        held = np.empty_like(part)
        for c in range(COORDINATES):
            np.bitwise_xor(part, keys[c], out=held)
            np.multiply(held, factors[c], out=held)
            out[lo:hi, c] = np.minimum.reduceat(held, at)
    return out


def sketches(tokens: np.ndarray) -> np.ndarray:
    """Two bits of a hash of each token, as bytes."""
    bits = (mix(tokens.astype(np.uint64) + stream(404, COORDINATES)) & np.uint64(3)).astype(np.uint8).reshape(len(tokens), COORDINATES // 4, 4)
    return bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6


def _features(k: int):
    """Size, identity, tokens and sketch of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in _sets(batch, k)]
            full = [s for s in found if len(s)]
            made = signatures(full) if full else np.zeros((0, COORDINATES), np.uint32)
            more = ((t.tobytes(), b.tobytes()) for t, b in zip(made[:, :TOKENS], sketches(made), strict=True))
            rows = [(len(s), *(int(mix(s + np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (1, 2)), *(next(more) if len(s) else (None, None))) for s in found]
            if rows:
                n, x, y, tokens, sketch = zip(*rows, strict=True)
                columns = [pa.array(v, pa.int64()) for v in (n, x, y)] + [pa.array(v, pa.binary()) for v in (tokens, sketch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "x", "y", "tokens", "sketch"])

    return run


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Byte strings of one length as rows of numbers."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _roots(trees: int):
    order = np.argsort(stream(303, TOKENS))[:trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column(1), np.uint32)[:, order].astype(np.uint64)
            nodes = mix(tokens + (np.arange(1, trees + 1, dtype=np.uint64) << np.uint64(32)))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), trees)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.reshape(-1).view(np.int64)), pa.array(ids)], ["node", "doc"])

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, its nodes, tokens) to its nodes one level down."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, lists = _matrix(batch.column(2), np.uint32), batch.column(1)
        nodes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        draw = mix(nodes + np.uint64(0xD1B54A32D192ED03))
        first = (draw % np.uint64(TOKENS)).astype(np.int64)
        second = (first + 1 + ((draw >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
        twice = np.flatnonzero((draw >> np.uint64(32)) % np.uint64(4) == 0)
        row, coordinate, parent = np.concatenate([row, row[twice]]), np.concatenate([first, second[twice]]), np.concatenate([nodes, nodes[twice]])
        child = mix(mix(parent + coordinate.astype(np.uint64)) ^ tokens[row, coordinate].astype(np.uint64))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids)], ["node", "doc"])


def _likely(least: int):
    """(doc, hub, their sketches) to the likely ones and how many places agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = agreement(_matrix(batch.column(2), np.uint64), _matrix(batch.column(3), np.uint64))
                keep = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(agree).filter(keep)], ["doc", "hub", "agree"])

    return run


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _askers(least: int, percent: int):
    """Of one node, or a pair of its blocks: (doc, cluster) of odd documents and clusters that hold a likely partner of another component."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        doc, n, comp, cluster = (group.column(c).to_numpy() for c in ("doc", "n_shingles", "comp", "cluster"))
        odd, member = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("odd", "member"))
        rows = _matrix(group.column("sketch"), np.uint64)
        inside, found = np.flatnonzero(member), []
        rows_in, comp_in, n_in, cluster_in = rows[inside], comp[inside], n[inside], cluster[inside]
        for i in np.flatnonzero(odd):
            near = (agreement(rows_in, rows[i]) >= least) & (comp_in != comp[i]) & _sizes_fit(n_in, n[i], percent)
            found += [(doc[i], c) for c in np.unique(cluster_in[near])]
        return pa.table({"doc": pa.array([d for d, _ in found], pa.int64()), "cluster": pa.array([c for _, c in found], pa.int64())})

    return run


def _small_askers(least: int, percent: int, most: int):
    """The same for nodes of at most ``most`` members that follow each other in sorted order, many at a time."""
    names = ["node", "doc", "n_shingles", "comp", "cluster", "odd", "sketch"]

    def asked(t: pa.Table) -> pa.RecordBatch:
        node, doc, n, comp, cluster = (t.column(c).to_numpy() for c in names[:5])
        odd, rows = t.column("odd").to_numpy(zero_copy_only=False).astype(bool), _matrix(t.column("sketch"), np.uint64)
        docs, clusters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for far in range(1, min(most, len(node))):
            i = np.flatnonzero((node[far:] == node[:-far]) & (comp[far:] != comp[:-far]) & (odd[far:] | odd[:-far]) & _sizes_fit(n[far:], n[:-far], percent))
            i = i[agreement(rows[i], rows[i + far]) >= least]
            for asks, of in ((i, i + far), (i + far, i)):
                docs.append(doc[asks][odd[asks]])
                clusters.append(cluster[of][odd[asks]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(clusters))], ["doc", "cluster"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            node = t.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, node[1:] != node[:-1]))[-1])  # the last node may go on
            held = t.slice(cut)
            if cut:
                yield asked(t.slice(0, cut))
        if held is not None:
            yield asked(held)

    return run


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [s.tobytes() for _, s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc", "shingles"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted sets have the asked similarity."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            keep = pa.array([_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _block_links(least: int, percent: int):
    """Of one block of a cluster's members and one of those that ask: links between components not joined before.

    Pairs already joined inside the block by links found there are passed over, so links form no more than a forest.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        doc, n, comp = (group.column(c).to_numpy() for c in ("doc", "n_shingles", "comp"))
        asks, member = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "member"))
        rows, sets = _matrix(group.column("sketch"), np.uint64), group.column("shingles").combine_chunks()
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        def of(i: int) -> np.ndarray:
            return np.frombuffer(sets[i].as_buffer(), np.uint64)

        inside, found = np.flatnonzero(member), []
        rows_in, comp_in, n_in = rows[inside], comp[inside], n[inside]
        for i in np.flatnonzero(asks).tolist():
            agree = agreement(rows_in, rows[i])
            near = np.flatnonzero((agree >= least) & (comp_in != comp[i]) & _sizes_fit(n_in, n[i], percent))
            own = of(i)
            for j in inside[near[np.argsort(-agree[near], kind="stable")]].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and _alike(own, of(j), percent):
                    root[max(x, y)] = min(x, y)
                    found.append((doc[i], doc[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, trees: int = 16, node_limit: int = 16, depth: int = 6, block: int = 8192, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id), a row for each row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A document's set are its distinct shingles of
    ``words`` words; one with fewer words has its whole sequence as one; one with no word or a null text has
    none and links with nothing. Sets link if 100 * intersection >= percent * union. ``component_id`` is the
    least id reached over links, ``kept`` tells the document with that id, ``class_id`` the least id with the
    same set. Ids must be unique; a row of a null id is compared with none, kept, and has a null component and
    class. An empty table gives no rows; other columns are ignored. Sets are compared by 64-bit hashes.

    What can be missed: a pair at 0.8 meets in no root node with probability 0.2**trees, and each further level
    that a crowded node makes it pass keeps about 1.25 * 0.8 nodes of it; its sketches disagree too much with
    probability 1.2e-6. The rows are read from three tables of
    ``scratch``, which the caller can drop when done.
    """
    spark = docs.sparkSession
    tune(spark)
    t = scratch or Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    features = t.put(texts.mapInArrow(_features(words), "doc_id long, n_shingles long, x long, y long, tokens binary, sketch binary"))
    same = ["x", "y", "n_shingles"]
    classes = t.counted(features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("doc")))
    own = t.counted(features.join(small(classes.select("doc"), t.size(classes), 16, t.most), F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("doc"), "n_shingles", "tokens", "sketch"))
    signed = small(own.select("doc", "n_shingles", "sketch"), t.size(own), SIGNED_BYTES, t.most)
    least = least_agreement(percent)

    def sets_of(ids: DataFrame, n: int) -> DataFrame:
        """(doc, shingles) of the documents in column doc of n rows, read from their texts again."""
        ids = ids.select(F.col("doc").alias("doc_id"))
        if 16 * n > t.most:
            ids = ids.distinct()
            n = ids.count()
        return texts.join(small(ids, n, 16, t.most), "doc_id", "left_semi").mapInArrow(_shingle_sets(words), "doc long, shingles binary")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are as alike as asked."""
        sets = t.put(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")), 2 * t.size(pairs)))
        both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
        found = t.counted(both.select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long"))
        t.drop(sets)
        return found

    def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
        """Labels (doc, label) after more links; documents not named are their own."""
        if not t.size(found):
            return labels
        if labels is None:
            made = components(found, t.size(found), t)
            return t.view(made.select(F.col("v").alias("doc"), "label"), made)
        known = t.small(labels, LABEL_BYTES)
        ends = [known.select(F.col("doc").alias(e), F.col("label").alias(f"l_{e}")) for e in "ab"]
        over = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
        new = components(over, t.size(found), t)
        if not t.size(new):  # all ends had one label already
            t.drop(new)
            return labels
        moved = labels.join(small(new.select(F.col("v").alias("label"), F.col("label").alias("to")), t.size(new), LABEL_BYTES, t.most), "label", "left").select("doc", F.coalesce("to", "label").alias("label"))
        fresh = new.select(F.col("v").alias("doc"), "label").join(known, "doc", "left_anti")
        out = t.counted(moved.unionByName(fresh))
        t.drop(labels, new)
        return out

    def labelled(rows: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(name, F.col("doc"))
        return rows.join(t.small(labels, LABEL_BYTES).withColumnRenamed("label", name), "doc", "left").withColumn(name, F.coalesce(name, "doc"))

    fits = 100 * F.least("n_shingles", "n_hub") >= percent * F.greatest("n_shingles", "n_hub")
    sequence = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    dealt = lambda n: F.pmod(F.xxhash64("doc"), n)

    def candidates(members: DataFrame, hubs: DataFrame) -> DataFrame:
        """(a, b): each document with its likeliest hub of another component; a pair comes twice if each is so to the other."""
        near = members.join(signed, "doc").join(hubs, "node").where("comp <> hub_comp").where(fits)
        likely = near.select("doc", "hub", "sketch", "hub_sketch").mapInArrow(_likely(least), "doc long, hub long, agree long")
        best = likely.groupBy("doc").agg(F.max(F.struct("agree", "hub")).alias("best"))
        return best.select(F.least("doc", "best.hub").alias("a"), F.greatest("doc", "best.hub").alias("b"))

    def askers(crowd: DataFrame) -> DataFrame:
        """(doc, cluster) of odd documents of nodes (node, n, others, doc, comp, main) and clusters with a likely partner."""
        rows = labelled(crowd.join(signed, "doc"), cluster, "cluster").withColumn("odd", F.col("comp") != F.col("main"))
        names = ["node", "doc", "n_shingles", "comp", "cluster", "odd", "sketch"]
        tiny = rows.where(F.col("n") <= node_limit).select(names).repartition("node").sortWithinPartitions("node")
        tiny = tiny.mapInArrow(_small_askers(least, percent, node_limit), "doc long, cluster long")
        rows = rows.where(F.col("n") > node_limit).withColumn("i_parts", F.ceil(F.col("n") / (4 * block))).withColumn("j_parts", F.ceil(F.col("others") / block))
        member = F.transform(sequence(F.col("j_parts")), lambda j: F.struct(dealt(F.col("i_parts")).alias("i"), j.alias("j"), F.lit(False).alias("odd"), F.lit(True).alias("member")))
        odd = F.transform(sequence(F.col("i_parts")), lambda i: F.struct(i.alias("i"), dealt(F.col("j_parts")).alias("j"), F.lit(True).alias("odd"), F.lit(False).alias("member")))
        rows = rows.select(*names[:5], "sketch", F.explode(F.when(F.col("odd"), F.concat(member, odd)).otherwise(member)).alias("at"))
        large = rows.select("node", *names[1:5], "sketch", "at.*").groupBy("node", "i", "j").applyInArrow(_askers(least, percent), "doc long, cluster long")
        return tiny.unionByName(large).distinct()

    def cluster_links(asks: DataFrame) -> DataFrame:
        """Links (a, b) between documents that ask and members of the clusters that they ask for."""
        asks = t.small(asks, 32)
        asking = asks.join(signed, "doc")
        members = labelled(signed, cluster, "cluster").join(asks.select("cluster"), "cluster", "left_semi")
        parts = lambda rows, name: rows.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias(name))
        blocks = t.counted(parts(members, "i_parts").join(parts(asking, "j_parts"), "cluster"))
        known = t.small(blocks, 32)
        members = members.join(known, "cluster").select("cluster", dealt(F.col("i_parts")).alias("i"), F.explode(sequence(F.col("j_parts"))).alias("j"), "doc", "n_shingles", "sketch", F.lit(False).alias("asks"), F.lit(True).alias("member"))
        asking = asking.join(known, "cluster").select("cluster", F.explode(sequence(F.col("i_parts"))).alias("i"), dealt(F.col("j_parts")).alias("j"), "doc", "n_shingles", "sketch", F.lit(True).alias("asks"), F.lit(False).alias("member"))
        rows = t.counted(labelled(members.unionByName(asking), comp, "comp"))
        found = t.counted(rows.join(sets_of(rows, t.size(rows)), "doc").groupBy("cluster", "i", "j").applyInArrow(_block_links(least, percent), "a long, b long"))
        t.drop(blocks, rows)
        return found

    comp: DataFrame | None = None  # (doc, label): joined by links
    cluster: DataFrame | None = None  # (doc, label): joined by candidates
    members, level = own.select("doc", "tokens").mapInArrow(_roots(min(trees, TOKENS)), "node long, doc long"), 1
    while True:
        rows = labelled(members, comp, "comp").withColumn("draw", F.xxhash64("node", "doc"))
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("draw").alias("first"), F.max("draw").alias("second")).where("low < high").drop("low", "high")
        drawn = ((F.col("draw") == F.col("first")) | (F.col("draw") == F.col("second"))).alias("hub")
        mixed, n_hubs = t.seen(rows.join(nodes, "node").select("node", "n", "doc", "comp", drawn), F.count_if("hub"))
        if not n_hubs:
            break
        hubs = mixed.where("hub").join(signed, "doc").select("node", F.col("doc").alias("hub"), F.col("comp").alias("hub_comp"), F.col("n_shingles").alias("n_hub"), F.col("sketch").alias("hub_sketch"))
        pairs = t.counted(candidates(mixed.drop("hub"), small(hubs, n_hubs, 160, t.most)))
        if t.size(pairs):
            found = links(pairs)
            comp, cluster = merged(comp, found), merged(cluster, pairs)
            t.drop(found)
        t.drop(pairs)
        crowd = t.put(labelled(mixed.select("node", "n", "doc"), comp, "comp"))
        t.drop(mixed)
        by_node = crowd.repartition("node")  # both counts and the join go by node
        per = by_node.groupBy("node", "comp").agg(F.count("*").alias("c"))
        still = per.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0").select("node", F.col("top.comp").alias("main"), "others")
        left, others = t.seen(by_node.join(still, "node"), F.max("others"))
        t.drop(crowd)
        last = level >= depth
        asks = t.counted(askers(left if last else left.where(F.col("others") <= block)))
        if t.size(asks):
            found = cluster_links(asks)
            comp = merged(comp, found)
            t.drop(found)
        t.drop(asks)
        if last or others <= block:
            break
        lists = left.where(F.col("others") > block).groupBy("doc").agg(F.collect_set("node").alias("nodes"))
        members = t.put(lists.join(own, "doc").select("doc", "nodes", "tokens").mapInArrow(_children, "node long, doc long"))
        t.drop(left)
        level += 1
    t.drop_all_but(features, classes, comp)
    named = features.join(t.small(classes, 64), same, "left").withColumn("doc", F.coalesce("doc", "doc_id"))
    out = labelled(named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("doc")).alias("doc")), comp, "comp")
    return out.select("doc_id", "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("comp") == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("doc").alias("class_id"))
