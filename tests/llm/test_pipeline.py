import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_neardup import brute
from tokenizers import Tokenizer

from tesselune.llm import common
from tesselune.storage import workspace

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or seen[-1].columns == columns, name
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:5]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in texts[1] for i in good]) > 0.95
    assert set(texts[2]) == {i for i, (_, c, _) in brute(list(texts[1].items()), 5).items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts[2].items() if any(x in t for x in items)}
    assert leaks and not leaks & set(texts[3]) and set(texts[2]) - set(texts[3]) <= {i for i, t in texts[2].items() if any(x[:20] in t or x[-20:] in t for x in items)}
    assert set(texts[4]) <= set(texts[3]) and all(texts[4][i] == texts[3][i] for i in texts[4])
    mixed = Counter(r.doc_id for r in seen[4].select("doc_id").collect())
    assert max(mixed.values()) <= 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = sorted(seen[5].collect(), key=lambda r: r.start), 0
    lies = seen[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert Counter(r.doc_id for r in got) == mixed and [r.doc_id for r in got] == [r.doc_id for r in sorted(lies, key=lambda r: (r.file_name, r.row_index))]
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    for r in got:
        ids = [*tokenizer.encode(texts[4][r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_null_and_repeated_ids(spark):
    said = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(6)]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(5, said[0]), (5, said[0]), (None, said[0]), (None, said[1]), (None, said[1]), (7, said[2]), (7, said[3]), (9, said[4]), (None, leak), (8, leak), (8, said[5])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    one_each = [(5, said[0]), (None, said[1]), (7, said[2]), (7, said[3]), (9, said[4]), (8, leak), (8, said[5])]
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(one_each)
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert clean.columns == docs.columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r[1] != leak)
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    got, had = Counter((r.doc_id, r.text) for r in mixed.collect()), Counter(rows)
    assert mixed.columns == docs.columns and set(got) == set(had) and all(had[x] <= n <= 2 * had[x] for x, n in got.items())


def reread(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_rows_are_dealt_as_the_splitting_tree_says(spark, tmp_path):
    from tesselune.llm.mixing import mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = sorted((r.shard, r.order_key, r.doc_id, r.epoch) for r in mix(docs, block_words=0)[1].collect())
    assert len({shard for shard, *_ in order}) == 8
    out = reread(spark, corpus_pipeline.mixture(spark, docs, SF), tmp_path / "mixed")
    lies = out.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r.doc_id for r in sorted(lies, key=lambda r: (r.file_name, r.row_index))] == [i for _, _, i, _ in order]


def test_empty_tables_clashing_columns_null_and_repeated_ids_in_all_stages(spark, tmp_path):
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0], 10), (1, good[1], 11), (None, good[2], 12), (None, good[3], 13), (3, None, 14), (4, "", 15)]
    made = spark.createDataFrame([(i, t, "s", n, n, n, n) for i, t, n in rows], "doc_id long, text string, source string, _row int, score int, row int, component_id int")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = reread(spark, made, tmp_path / f"in{k}")
        out = stage(spark, docs, SF)
        if k == 4:
            got = sorted(((r.doc_id, r.n_tokens > 1) for r in out.collect()), key=str)
            assert got == sorted(((i, bool(t)) for i, t, _ in rows), key=str), name
        else:
            found = {(r.doc_id, r.text, r._row, r.score, r.row, r.component_id) for r in out.collect()}
            assert out.columns == docs.columns and found <= {(i, t, n, n, n, n) for i, t, n in rows}, name
            assert {n for _, _, n, *_ in found} >= {10, 11, 12, 13} or k == 0 and found, name
        assert stage(spark, reread(spark, made.limit(0), tmp_path / f"none{k}"), SF).count() == 0, name


def test_a_run_leaves_its_token_files_alone(spark):
    with workspace(spark) as path:
        rows = corpus_pipeline.run(spark, SF).collect()
        left = [p for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert rows and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert left and all(".arrow" in p.name or p.parent.name == "manifest" for p in left)
    assert not Path(path.removeprefix("file:")).exists()


def test_rows_that_lie_in_no_files_go_by_their_ids(spark):
    made = spark.createDataFrame([(9, "nine words"), (2, "two"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.tokens(spark, made, SF).orderBy("start").collect()] == [None, 2, 9]


def test_broadcasts_of_near_duplicates_keep_to_the_stages_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hinted, hint = [], common.broadcast
    monkeypatch.setattr(common, "broadcast", lambda df: hinted.append(df) or hint(df))
    usual = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert hinted
    hinted.clear()
    monkeypatch.setattr(corpus_pipeline, "NEAR_BROADCAST", -1)  # even an empty table is too large
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == usual and not hinted


def test_what_is_seen_of_a_table_as_it_is_written(spark):
    t = common.Scratch(spark)
    for n, total in ((5, 10), (0, 0)):
        out, seen = t.seen(spark.range(5).where(f"id < {n}").repartition(3), F.sum("id"))
        assert (out.count(), seen) == (n, total)
