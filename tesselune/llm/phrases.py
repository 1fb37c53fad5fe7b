"""Phrases whose words keep together, by count tries of limited depth.

Every shard (a partition of the documents) counts its phrases in a trie and serialises it sorted, a piece for each
range of prefixes; the shards' pieces of a range are merged in one task. A range goes by a prefix of two or three
words, so that a frequent first word falls into many. A part of
a phrase occurs at least as often as the phrase: so words are counted first, then pairs of frequent words, then
phrases of three to five words whose pairs are all frequent. What is frequent goes to the tasks as a Bloom filter
of bounded size: it lets some others through, which are counted and fall away, and holds back none.
In the merged trie a walk from the root gives the counts of a phrase's left parts, and suffix links (the node of
the same path without its first word) those of its right parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, tune
from .textkernel import SPACES, Words, byte_set, mix, slices, windows

#: Bytes that end a piece of text; a phrase lies inside of one.
ENDS = byte_set(b".,;:!?\n\v\f\r")
DEPTH = 5
#: A shard's trie is written and begun anew when it holds so many paths.
PATHS = 1 << 18
#: Words of the corpus for each range of prefixes.
RANGE_WORDS = 1 << 18
#: Bits of the filter of what is frequent: 16 for each entry, up to 32 MB in all.
FILTER_BITS = 1 << 28


def pack(paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted paths and their counts; of a path what it shares with the one before is left out."""
    shared = np.zeros(len(paths), np.uint8)
    shared[1:] = (np.cumsum(paths[1:] != paths[:-1], 1) == 0).sum(1)
    own = paths[np.arange(paths.shape[1]) >= shared[:, None]]
    return b"".join((len(paths).to_bytes(8, "little"), shared.tobytes(), own.astype("<u8").tobytes(), counts.astype("<i8").tobytes()))


def unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    shared = np.frombuffer(blob, np.uint8, n, 8)
    own = np.arange(width) >= shared[:, None]
    size = int(own.sum())
    paths = np.zeros((n, width), np.uint64)
    paths[own] = np.frombuffer(blob, "<u8", size, 8 + n)
    last = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), 0)
    return np.take_along_axis(paths, last, 0), np.frombuffer(blob, "<i8", n, 8 + n + 8 * size)


class CountTrie:
    """How often each path of tokens occurs; a path of less than ``width`` tokens ends in zeros."""

    def __init__(self, width: int):
        self.width, self.fresh, self.n_fresh = width, [], 0
        self.paths, self.counts = np.zeros((0, width), np.uint64), np.zeros(0, np.int64)

    def add(self, paths: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.fresh.append((paths, np.ones(len(paths), np.int64) if counts is None else counts))
        self.n_fresh += len(paths)
        if self.n_fresh >= 2 * PATHS:
            self.settle()

    def settle(self) -> None:
        paths = np.concatenate([self.paths, *(p for p, _ in self.fresh)])
        counts = np.concatenate([self.counts, *(c for _, c in self.fresh)])
        self.fresh, self.n_fresh = [], 0
        if len(paths):
            order = np.lexsort(paths.T[::-1])
            paths = paths[order]
            begins = np.flatnonzero(np.concatenate([[True], (paths[1:] != paths[:-1]).any(1)]))
            self.paths, self.counts = paths[begins], np.add.reduceat(counts[order], begins)

    def full(self) -> bool:
        return len(self.paths) >= PATHS

    def _taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        paths, counts = self.paths, self.counts
        self.paths, self.counts = paths[:0], counts[:0]
        return paths, counts

    def pieces(self, prefix: int, ranges: int) -> pa.RecordBatch:
        """(range, trie): the paths, serialised by the range of their first ``prefix`` tokens; the trie is empty then."""
        paths, counts = self._taken()
        at = (windows(paths[:, :prefix].reshape(-1), prefix)[::prefix] % np.uint64(ranges)).astype(np.int64) if len(paths) else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        found, begins = np.unique(at[order], return_index=True)
        blobs = [pack(paths[part], counts[part]) for part in np.split(order, begins[1:])] if len(found) else []
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], ["range", "trie"])

    def nodes(self, least_depth: int, least: int = 1) -> pa.RecordBatch:
        """(w1, ..., f): the nodes of that depth and more met ``least`` times, parents before children, sorted by path; the trie is empty then."""
        paths, counts = self._taken()
        firsts, depths, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        new = np.zeros(len(paths), bool)
        new[:1] = True
        for depth in range(1, self.width + 1):
            new[1:] |= paths[1:, depth - 1] != paths[:-1, depth - 1]
            begins = np.flatnonzero(new)
            if depth >= least_depth and len(begins):
                total = np.add.reduceat(counts, begins)
                kept = (paths[begins, depth - 1] != 0) & (total >= least)
                firsts.append(begins[kept])
                sums.append(total[kept])
                depths.append(np.full(len(firsts[-1]), depth))
        first, depth, total = np.concatenate(firsts), np.concatenate(depths), np.concatenate(sums)
        order = np.lexsort((depth, first))
        first, depth, total = first[order], depth[order], total[order]
        columns = [pa.array(np.where(depth > k, paths[first, k], 0).astype(np.uint64).view(np.int64)) for k in range(self.width)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total)], [*(f"w{k}" for k in range(1, self.width + 1)), "f"])


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]]:
    """(token, piece, document's row, words, bytes) of rows (lang, text); a token stands for a word in a language, never 0."""
    langs = batch.column(0).dictionary_encode()
    hashes = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    for lo, _, data, offsets in slices(batch.column(1)):
        words = Words(data, offsets, lower=True, breaks=SPACES | ENDS)
        ends = ENDS[data]
        ends[offsets[:-1][offsets[:-1] < len(data)]] = True
        row = lo + np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        yield mix(words.hashes ^ hashes[row]) | np.uint64(1), np.cumsum(ends, dtype=np.int64)[words.starts], row, words, data


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, f, lang, word) of each shard's words."""
    trie, texts = CountTrie(1), {}

    def rows() -> pa.RecordBatch:
        nodes = trie.nodes(1)
        pairs = [texts[k] for k in nodes.column(0).to_numpy().view(np.uint64).tolist()]
        lang, word = (pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*nodes.columns, lang, word], ["w1", "f", "lang", "word"])

    for batch in batches:
        for token, _, row, words, data in _tokens(batch):
            trie.add(token[:, None])
            found, at = np.unique(token, return_index=True)
            for key, i in zip(found.tolist(), at.tolist(), strict=True):
                if key not in texts:
                    texts[key] = batch.column(0)[int(row[i])].as_py(), data[words.starts[i] : words.ends[i]].tobytes().decode().translate(_LOWER)
            if len(texts) >= PATHS:
                yield rows()
                texts = {}
    yield rows()


_LOWER = {c: c + 32 for c in range(65, 91)}


_SHIFTS = (1, 20, 36)


class Filter:
    """A Bloom filter with three places for each key; ``bits`` is a power of two."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame, n: int, least: int = 1 << 16) -> Filter:
        """Of the n longs in column key; what comes to the driver is the filter, of at most ``FILTER_BITS``."""
        bits = max(least, min(FILTER_BITS, 1 << (16 * n).bit_length()))
        key = F.col("key")
        places = F.array(*(F.shiftrightunsigned(key, shift).bitwiseAND(bits - 1) for shift in _SHIFTS))
        rows = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS int))")).alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return cls(bits, words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in _SHIFTS:
            place = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
        return out


def _pairs(frequent, ranges: int):
    """(range, trie) of each shard's pairs of words that the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(2)
        for batch in batches:
            for token, piece, *_ in _tokens(batch):
                known = frequent.value.has(token)
                at = np.flatnonzero(known[1:] & known[:-1] & (piece[1:] == piece[:-1]))
                trie.add(np.stack([token[at], token[at + 1]], 1))
                if trie.full():
                    yield trie.pieces(2, ranges)
        yield trie.pieces(2, ranges)

    return run


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    return windows(tokens, 2)


def _phrases(frequent, ranges: int):
    """(range, trie) of each shard's phrases of three words and more all of whose pairs the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(DEPTH)
        for batch in batches:
            for token, piece, *_ in _tokens(batch):
                if len(token) < 3:
                    continue
                linked = frequent.value.has(pair_keys(token)) & (piece[1:] == piece[:-1])
                linked = np.concatenate([linked, np.zeros(DEPTH, bool)])
                at = np.flatnonzero(linked[:-1] & linked[1:])
                paths, on = np.zeros((len(at), DEPTH), np.uint64), np.ones(len(at), bool)
                padded = np.concatenate([token, np.zeros(DEPTH, np.uint64)])
                for k in range(DEPTH):
                    on &= linked[at + k - 1] if k else True
                    paths[:, k] = np.where(on, padded[at + k], 0)
                trie.add(paths)
                if trie.full():
                    yield trie.pieces(3, ranges)
        yield trie.pieces(3, ranges)

    return run


def _merged(least: int, width: int):
    """Pieces of tries sorted by range to the nodes met ``least`` times in all; a range's rows may span batches."""
    prefix = min(width, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = CountTrie(width), None
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != current and current is not None:
                    yield trie.nodes(prefix, least)
                current = at
                trie.add(*unpack(blob.as_buffer().to_pybytes(), width))
        if current is not None:
            yield trie.nodes(prefix, least)

    return run


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns], 1).reshape(-1)
        keys = pair_keys(pairs)[::2] if len(pairs) else pairs
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\n-\\r]`` into pieces and these into words ``[^ \\t]+``. A null text is
    empty, a null language ``und``. Candidates are phrases of 2 to 5 words met a >= ``least`` times; a cut after k words
    has l and r, the counts of both parts, and n is the number of words of the language. score is the least
    floor(1000 a n / (l r)) of a candidate's cuts, at the first cut that has it. A candidate inside a longer one that is
    met as often falls away. Ranks go by score and a descending, then by the phrase's bytes. An empty table gives no
    rows; other columns, and ids of any kind, are ignored. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    tune(spark)
    t = Scratch(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = t.put(texts.mapInArrow(_words, "w1 long, f long, lang string, word string").groupBy("w1", "lang", "word").agg(F.sum("f").alias("f")))
    sizes = t.put(words.groupBy("lang").agg(F.sum("f").alias("n")))
    counted = sizes.agg(F.count("*").alias("langs"), F.sum("n").alias("words")).first()
    n_langs, ranges = counted.langs, max(1, -(-(counted.words or 0) // RANGE_WORDS))
    frequent = t.put(words.where(F.col("f") >= least))
    t.drop(words)

    def merged(tries, width: int) -> DataFrame:
        """The nodes of all shards' tries, by ranges of prefixes."""
        pieces = texts.mapInArrow(tries, "range long, trie binary").repartition("range").sortWithinPartitions("range")
        return t.put(pieces.mapInArrow(_merged(least, width), ", ".join(f"w{k} long" for k in range(1, width + 1)) + ", f long"))

    def held(keys: DataFrame, n: int):
        return spark.sparkContext.broadcast(Filter.of(keys, n))

    known = held(frequent.select(F.col("w1").alias("key")), frequent.count())
    pairs = merged(_pairs(known, ranges), 2)
    known.destroy()
    known = held(pairs.select("w1", "w2").mapInArrow(_with_key, "key long"), pairs.count())
    longer = merged(_phrases(known, ranges), DEPTH)
    known.destroy()

    empty = F.array().cast("array<bigint>")
    above = frequent.select("w1", "lang", "f", empty.alias("lefts"), empty.alias("rights"))
    found = []
    for depth in range(2, DEPTH + 1):
        path = [f"w{k}" for k in range(1, depth + 1)]
        own = pairs if depth == 2 else longer.where((F.col(f"w{depth}") != 0) & (F.col(f"w{depth + 1}") == 0) if depth < DEPTH else F.col(f"w{depth}") != 0).select(*path, "f")
        parent = above.withColumnRenamed("f", "f_left")
        link = above.select(*(F.col(f"w{k}").alias(f"w{k + 1}") for k in range(1, depth)), F.col("f").alias("f_right"), F.col("rights").alias("more"))
        rows = own.join(parent, path[:-1]).drop("rights").join(link, path[1:])
        rows = rows.select(*path, "lang", "f", "f_left", "f_right", F.concat("lefts", F.array("f_left")).alias("lefts"), F.concat(F.array("f_right"), "more").alias("rights"))
        rows = t.put(rows)
        if depth > 2:  # shorter phrases inside of these that are met no more often
            inside = rows.where("f >= f_left").select(path[:-1]).unionByName(rows.where("f >= f_right").select(*(F.col(f"w{k}").alias(f"w{k - 1}") for k in range(2, depth + 1))))
            found[-1] = found[-1].join(inside.distinct(), path[:-1], "left_anti")
        above = rows.drop("f_left", "f_right")
        found.append(above)
    candidates = None
    for depth, rows in enumerate(found, 2):
        rows = rows.select(F.array(*(f"w{k}" for k in range(1, depth + 1))).alias("path"), "lang", "f", "lefts", "rights")
        candidates = rows if candidates is None else candidates.unionByName(rows)
    cuts = """array_min(transform(sequence(1, size(path) - 1), k -> named_struct(
        'score', (CAST(1000 AS decimal(4,0)) * CAST(f AS decimal(19,0)) * CAST(n AS decimal(19,0))) div (CAST(lefts[k - 1] AS decimal(19,0)) * CAST(rights[k - 1] AS decimal(19,0))),
        'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))"""
    scored = candidates.join(small(sizes, n_langs, 64), "lang").withColumn("cut", F.expr(cuts)).select("lang", "path", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = t.put(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))  # ties of the last place included
    spelt = near.select("path", F.posexplode("path").alias("at", "w1")).join(frequent.select("w1", "word"), "w1")
    spelt = spelt.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = near.join(spelt, "path")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = t.put(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    t.drop_all_but(out)
    return out
