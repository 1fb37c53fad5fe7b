"""Token ids in Arrow files of equal-length sequences, which a reader maps into memory and slices without a copy.

Documents are dealt out by ranges of ``doc_id``; each range becomes a shard of two Arrow IPC files. In the first
a record batch holds ``BATCH_ROWS`` rows of (ids: fixed-size list of ``length`` uint16 or uint32, mask:
fixed-size list of bool); the documents' ids follow each other without gaps, only a shard's last sequence is
padded, with the mask false. The second lists doc_id, start in the shard and n_tokens. Any sequence, and any
document, is a slice of buffers at known places.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, tune
from .textkernel import byte_set

#: Sequences of a record batch.
BATCH_ROWS = 256
#: Words whose ids a Python worker remembers, over all its tasks; beyond, it starts anew.
REMEMBERED = 1_000_000
#: Texts that are encoded together.
ENCODED = 400


def _letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 itself, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


_LETTERS = _letters()
_SMALL, _STOPS = byte_set(bytes(range(97, 123))), byte_set(b".,;:!?")


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, so that words can be encoded once each.

    ASCII white space never is part of a token of such a tokenizer, and its normaliser and splitter look at
    no more than what lies between; so a text's ids are those of its words in order. As it lower-cases and ends
    tokens between a letter and a stop, words are lower-cased and cut there first, so that fewer differ; not so
    in a text that might hold a special token, which is looked for before, nor in one that holds a mark of U+0300
    to U+036F. The normaliser composes first and lower-cases last, and a few capitals do not compose with a mark
    as their small letters do (H with a macron below); no marks but these compose with ASCII letters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._plain()
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _plain(self) -> bool:
        """Whether the tokenizer is of the kind described: it lower-cases, drops white space, cuts before stops, and
        gives each of some probes, as one text, the ids of its words written apart. Others encode whole texts."""
        probes = ("Ab cD.\te,F; g!\n h", "x'Y z-1 (a) 2.5", "one\x0btwo\x0c three\r\nÉa", "  lead  trail  ")
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        by_words = [[k for w in re.sub(r"([a-z])([.,;:!?])", r"\1 \2", p.lower()).split() for k in ids(w)] for p in probes]
        words = ["ab", "wordlike", "zéro", "straße"]
        return [ids(p) for p in probes] == by_words and self._ids(words) == [ids(w) for w in words]

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words. What is all letters, lower case and normal is one piece to normaliser and splitter, and
        goes straight to the model, its bytes written as the model has them; other words go the whole way."""
        tokenize, whole = self.tokenizer.model.tokenize, [not (w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w)) for w in words]
        long_way = iter(self.tokenizer.encode_batch_fast([w for w, k in zip(words, whole, strict=True) if k], add_special_tokens=False))
        return [next(long_way).ids if k else [t.id for t in tokenize(w if w.isascii() else "".join(map(_LETTERS.__getitem__, w.encode())))] for w, k in zip(words, whole, strict=True)]

    def _split(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, lower-cased and cut before a stop that follows a letter, unless the text must stay as it is."""
        whole = [b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts]
        low = [b"" if k else t.lower() for t, k in zip(texts, whole, strict=True)]
        data, offsets = np.frombuffer(b"".join(low), np.uint8), np.cumsum([0, *map(len, low)])
        cuts = np.flatnonzero(_STOPS[data[1:]] & _SMALL[data[:-1]]) + 1
        cuts = cuts[~np.isin(cuts, offsets)]
        places, spaced = offsets + np.searchsorted(cuts, offsets), np.insert(data, cuts, 32).tobytes()
        return [t.split() if k else spaced[a:b].split() for t, k, a, b in zip(texts, whole, places[:-1].tolist(), places[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if not self.plain:
            made = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array([*x.ids, end], self.dtype) for x in made]
        if len(self.places) > REMEMBERED:
            self._clear()
        split = self._split(texts)
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = list(dict.fromkeys(words[k] for k in unknown.tolist()))
            made = self._ids([w.decode("utf-8", "replace") for w in new])
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), self.dtype, int(lengths.sum()))])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            at[unknown] = [self.places[words[k]] for k in unknown.tolist()]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [np.append(ids[a:b], self.dtype(end)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Writes one shard; holds no more than a batch of sequences."""

    def __init__(self, where: pyarrow.fs.FileSystem, path: str, length: int, dtype: type):
        self.length, self.dtype, self.total = length, dtype, 0
        ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), False), length)
        self.schema = pa.schema([pa.field("ids", ids, False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [where.open_output_stream(path), where.open_output_stream(path + ".index")]
        self.writers = [pa.ipc.new_file(self.files[0], self.schema), pa.ipc.new_file(self.files[1], self.index_schema)]
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = self.total + np.cumsum(lengths) - lengths
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(lengths)], schema=self.index_schema))
        self.total += int(lengths.sum())
        self.held += ids
        self.n_held += int(lengths.sum())
        if self.n_held >= BATCH_ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat, full = np.concatenate(self.held or [np.zeros(0, self.dtype)]), BATCH_ROWS * self.length
        cut = len(flat) if last else len(flat) // full * full
        for lo in range(0, cut, full):
            part = flat[lo : min(cut, lo + full)]
            rows = -(-len(part) // self.length)
            padded = np.zeros(rows * self.length, self.dtype)
            padded[: len(part)] = part
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((padded, np.arange(len(padded)) < len(part)), self.schema, strict=True)]
            self.writers[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held, self.n_held = [flat[cut:].copy()], len(flat) - cut

    def close(self) -> None:
        self._flush(True)
        for x in (*self.writers, *self.files):
            x.close()


class SequenceReader:
    """Random access to a shard's sequences and documents."""

    def __init__(self, path: str):
        where, at = pyarrow.fs.FileSystem.from_uri(path)
        local = isinstance(where, pyarrow.fs.LocalFileSystem)
        opened = [pa.memory_map(p) if local else where.open_input_file(p) for p in (at, at + ".index")]
        self.file, index = pa.ipc.open_file(opened[0]), pa.ipc.open_file(opened[1])
        self.index = index.read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint16))

    def _batch(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self._last = (k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True))
        return self._last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, a view of the file, and mask of the k-th sequence."""
        row = self.file.get_batch(k // BATCH_ROWS).slice(k % BATCH_ROWS, 1)
        return row.column(0).flatten().to_numpy(zero_copy_only=True), row.column(1).flatten().to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        full, parts = BATCH_ROWS * self.length, []
        while n:
            part = self._batch(start // full)[start % full :][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _write(tokenizer: str, end: int, length: int, folder: str):
    """Rows (part, first, doc_id, text) to the manifest's; rows that do not follow each other begin a new shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        where, root = pyarrow.fs.FileSystem.from_uri(folder)
        open_shard: tuple | None = None

        def closed() -> pa.RecordBatch:
            writer, part, first, name, n_docs = open_shard
            writer.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.string()), "first": pa.array([first], pa.int64()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [writer.total]})

        for batch in batches:
            parts, firsts = batch.column(0), batch.column(1)
            cuts = [0, batch.num_rows]
            if batch.num_rows and parts[0].is_valid:  # places in files
                at, named = firsts.to_numpy(), np.array(parts.to_pylist(), object)
                cuts = [0, *(np.flatnonzero((at[1:] != at[:-1] + 1) | (named[1:] != named[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part, first = parts[lo].as_py(), firsts[lo].as_py()
                if open_shard and part is not None and (part, first) != (open_shard[1], open_shard[2] + open_shard[4]):
                    yield closed()
                    open_shard = None
                if not open_shard:
                    where.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.arrow"  # a name of its own for each attempt; the manifest has those that ended
                    open_shard = SequenceWriter(where, f"{root}/{name}", length, words.dtype), part, first, name, 0
                for k in range(lo, hi, ENCODED):
                    own = batch.slice(k, min(ENCODED, hi - k))
                    texts = [t.encode() for t in own.column(3).to_pylist()]
                    open_shard[0].add(own.column(2), words.encode(texts, end))
                open_shard = (*open_shard[:4], open_shard[4] + hi - lo)
        if open_shard:
            yield closed()

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2, length: int = 1024, as_they_lie: bool = False
) -> DataFrame:
    """Encodes whole texts in ascending id order to shards under ``folder``; the manifest, also written there.

    Manifest: (part, first, path, n_docs, n_tokens), a row for each shard, part and first giving their order. A null
    text is an empty one and has the end id alone. Rows of one id stay together, in the order of their texts;
    so do those of a null id, which come first and keep it (a shard that begins with them has a null first).
    With ``as_they_lie`` the order is that of docs' files, by name and row, and no text is shuffled: docs must
    be read from files, and a shard holds rows that follow each other in one.
    ``folder`` must be a place that all executors reach and ``pyarrow.fs`` can open. A task that is run again
    writes files of its own, and only what the manifest names counts. An empty table gives no shards.
    """
    tune(docs.sparkSession)
    texts = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    if as_they_lie:
        ordered = docs.select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("first"), *texts)
    else:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = docs.select(*texts).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
        ordered = ordered.select(F.lit(None).cast("string").alias("part"), F.col("doc_id").alias("first"), "doc_id", "text")
    return stored(ordered.mapInArrow(_write(tokenizer, end, length, folder), "part string, first long, path string, n_docs long, n_tokens long"), f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = SequenceReader(path)
            for part in shard.index.to_batches():
                ids, (starts, lengths) = part.column(0), (part.column(k).to_numpy() for k in (1, 2))
                sums = [zlib.crc32(shard.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest.

    start counts the ids of all documents before it, over all shards; the sum is over one row a shard.
    """
    before = Window.orderBy(F.length("part"), "part", "first").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    shards = shards.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return shards.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the token files of docs to a new shared folder and reads them back."""
    return read_documents(write_tokens(docs, shared_dir(docs.sparkSession), tokenizer, **options))
