import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tesselune.llm.tokenfiles import SequenceReader, WordEncoder, read_documents, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, World! don't stop 's a b \x1c \x85 é ́x",
    "<|endoftext|> <|startoftext|>x <|endof text|>",
    "ΑΣ ΣΑΣ İstanbul 12345 ###%%% 日本語 🙂🙂",
    "word\x0bvertical\x0cfeed " * 400,
    "dup dup dup",
    "dup dup dup",
]


def test_files_hold_the_tokenizers_ids(spark, tmp_path):
    rows = [(i * 7 - 3, t, i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, start long")
    manifest = write_tokens(docs, f"file://{tmp_path}/out", PATH, length=16)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_documents(manifest).collect()}
    t, start = Tokenizer.from_file(PATH), 0
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_capitals_before_combining_marks():
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = ["H\u0331 alil", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    texts += [f"{chr(a)}{between}{m}la. A" for a in range(65, 91) for m in marks for between in ("", "\u05b0", "\u0323")]
    got, t = WordEncoder(PATH).encode([x.encode() for x in texts], 2), Tokenizer.from_file(PATH)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], ascii(text)


def test_sequences_are_views_of_the_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c " * 3000)], "doc_id long, text string").coalesce(1)
    shard = SequenceReader(write_tokens(docs, f"file://{tmp_path}/out", PATH, length=8).first().path)
    total = shard.index.column("n_tokens")[0].as_py()
    rows = sum(shard.file.get_batch(k).num_rows for k in range(shard.file.num_record_batches))
    assert rows == -(-total // 8)
    before = pa.total_allocated_bytes()
    ids, mask = shard.sequence(rows - 1)
    assert mask.sum() == total - 8 * (rows - 1) and len(ids) == 8 and not ids.flags.owndata
    assert pa.total_allocated_bytes() - before < 4096
    joined = np.concatenate([shard.sequence(k)[0][shard.sequence(k)[1]] for k in range(rows)])
    assert (joined == shard.tokens(0, total)).all()


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "b"), (2**60 + 1, "d e"), (None, "a"), (None, None), (7, "c"), (7, "c"), (7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = write_tokens(docs, f"file://{tmp_path}/out", PATH, length=16)
    got = [tuple(r) for r in read_documents(manifest).orderBy("start").collect()]
    t, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_documents(write_tokens(docs, f"file://{tmp_path}/out", PATH)).count() == 0


def test_any_tokenizer_and_real_texts():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["a... b?! c.,d e.x.", "Ab.Cd,", ".", "", "x.\x00.y", "é.é, É."]
    for name, plain in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encoder, t = WordEncoder(path), Tokenizer.from_file(path)
        assert encoder.plain == plain
        for text, ids in zip(texts, encoder.encode([x.encode() for x in texts], 2), strict=True):
            assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
