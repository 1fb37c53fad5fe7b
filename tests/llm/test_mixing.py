import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesselune.llm.mixing import _hypergeometric, mix, mixed_documents, shard_quotas, taken, write_shards


def corpus(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i * 37 % 90)), f"s{i % 4}" if i % 5 else None, 1) for i in range(400)]
    rows += [(1000, None, "s0", 1), (1001, "", "only empty", 1), (1002, " \n", None, 1), (1003, "x\x85y " * 5000, "s1", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_takes(spark):
    rows, docs = corpus(spark)
    sizes, blocks = mix(docs, block_words=16)
    got = {r.doc_id: r for r in taken(sizes, blocks).collect()}
    size, per = {}, defaultdict(int)
    for i, t, s, _ in rows:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        per[s] += size[i]
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(per.values())
    while free:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * per[s]}
        for s in over or free:
            target[s] = 2 * per[s] if over else left * weight[s] / sum(weight[x] for x in free)
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    took = defaultdict(int)
    for i, _, s, _ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], per[s]) and r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r.size
        took[s] += r.taken
    for s in per:
        assert took[s] == pytest.approx(target[s], abs=1)
    again = {r.doc_id: r.taken for r in taken(*mix(docs.repartition(7), block_words=16)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_shards_are_disjoint_and_whole(spark, tmp_path):
    _, docs = corpus(spark)
    _, blocks = mix(docs, block_words=16, shards=5)
    rows = blocks.collect()
    assert len({(r.doc_id, r.epoch, r.block) for r in rows}) == len(rows)
    count = defaultdict(int)
    for r in rows:
        count[r.shard] += 1
    assert set(count) == set(range(5)) and max(count.values()) - min(count.values()) <= 3
    write_shards(docs, blocks, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == len(rows)
    both = written.join(blocks.select("doc_id", "epoch", "block", "words"), ["doc_id", "epoch", "block"])
    assert both.count() == len(rows) and both.where(F.size(F.split("text", " ")) != F.col("words")).count() == 0
    lies = written.select("shard", "order_key", "_metadata.file_name", "_metadata.row_index").collect()
    for shard in range(5):
        keys = [r.order_key for r in sorted(lies, key=lambda r: (r.file_name, r.row_index)) if r.shard == shard]
        assert keys == sorted(keys) and len(keys) == count[shard]


def test_whole_documents(spark):
    rows, docs = corpus(spark)
    sizes, blocks = mix(docs, block_words=0)
    out = mixed_documents(docs, blocks)
    assert out.columns == docs.columns
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in out.collect())
    per = taken(sizes, blocks).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()
    assert all(abs(r.t - r.want) <= 90 or r.source == "s1" and abs(r.t - r.want) <= 5000 for r in per)


def test_a_shard_spans_several_tasks(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'a b c' AS text", "'s' AS source")
    _, blocks = mix(docs, block_words=0, shards=2)
    place = {r.doc_id: [] for r in docs.collect()}
    for r in blocks.collect():
        place[r.doc_id].append((r.shard, r.order_key))
    parts = [x for x in mixed_documents(docs, blocks).rdd.map(lambda r: r.doc_id).glom().collect() if x]
    assert len(parts) == 4 and sum(map(len, parts)) == sum(map(len, place.values()))
    ids = [i for x in parts for i in x]
    assert ids == [i for _, i in sorted((at, i) for i, ats in place.items() for at in ats)]


def test_draws_are_hypergeometric(spark):
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    from math import comb

    for total, marked, drawn in ((20, 8, 5), (50, 45, 30), (7, 0, 3), (7, 7, 3), (9, 4, 0), (9, 4, 9)):
        got = {r.k: r.n for r in u.select(F.expr(_hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", "u")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
        for k in range(drawn + 1):
            want = comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) if drawn - k <= total - marked else 0
            assert got.get(k, 0) / 2000 == pytest.approx(want, abs=0.002)


def test_quotas_add_up(spark):
    quotas = spark.createDataFrame([(1, 1_000_000), (2, 0), (3, 17), (4, 12345)], "rank int, quota long")
    got = shard_quotas(quotas, 7, 3).collect()
    assert len(got) == 28 and all(r.quota >= 0 for r in got)
    for rank, quota in ((1, 1_000_000), (2, 0), (3, 17), (4, 12345)):
        assert sum(r.quota for r in got if r.rank == rank) == quota


def test_no_rows(spark):
    sizes, blocks = mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert sizes.count() == 0 and blocks.count() == 0


def test_rows_go_where_their_blocks_go(spark):
    rows, docs = corpus(spark)
    docs = docs.selectExpr("*", "doc_id AS shard", "'k' AS order_key", "1 AS _taken", "2 AS rank", "3 AS epoch", "4 AS _mix", "5 AS row").repartition(3)
    sizes, blocks = mix(docs, block_words=0, shards=5)
    want = defaultdict(int)
    for r in blocks.collect():
        want[r.doc_id] += 1
    for ordered in (True, False):
        out = mixed_documents(docs, blocks, ordered=ordered)
        assert out.columns == docs.columns
        got = defaultdict(int)
        for r in out.collect():
            got[r.doc_id] += 1
            assert (r.shard, r.order_key, r._taken, r["rank"], r.epoch, r._mix, r["row"]) == (r.doc_id, "k", 1, 2, 3, 4, 5)
        assert got == want


def test_shards_of_documents(spark):
    _, docs = corpus(spark)
    for shards in (1, 5):
        sizes, blocks = mix(docs, block_words=16, shards=shards)
        held, quota = defaultdict(set), defaultdict(int)
        for r in blocks.collect():
            held[r.doc_id].add(r.shard)
            quota[r["rank"], r.shard] += 1
        got = taken(sizes, blocks).collect()
        assert all(r.shards == ",".join(map(str, sorted(held[r.doc_id]))) and (r.taken > 0) == bool(r.shards) for r in got)
        asked = spark.createDataFrame([(k, sum(n for (rank, _), n in quota.items() if rank == k)) for k in {rank for rank, _ in quota}], "rank int, quota long")
        assert {(r["rank"], r.shard): r.quota for r in shard_quotas(asked, shards, 17).collect() if r.quota} == dict(quota)
