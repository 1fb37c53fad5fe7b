import hashlib
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselune.llm.exactdup import QuotientFilter, _filters, exact_duplicates

prints = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 20), max_size=300)


@settings(max_examples=50, deadline=None)
@given(prints, prints)
def test_filters_merge_without_loss(a, b):
    both = QuotientFilter.of(np.array(a, np.uint64)).merge(QuotientFilter.of(np.array(b, np.uint64)))
    back = QuotientFilter.from_bytes(both.to_bytes())
    want, counts = np.unique(np.array(a + b, np.uint64), return_counts=True)
    assert (back.prints() == want).all() and (back.counts == counts).all()


def test_large_counts_survive():
    f = QuotientFilter(np.array([3, 9], np.uint64), np.array([254, 100_000]))
    assert QuotientFilter.from_bytes(f.to_bytes()).counts.tolist() == [254, 100_000]


def test_groups(spark):
    texts = [None, "", "A b", "a B", "a b ", "É", "é", "x" * 100_000, "X" * 100_000, *["hot"] * 500]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(5)).collect()}
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [k for k, u in enumerate(norm) if u == t]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(rows)


def test_no_rows(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids_leave_one_row_a_group(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "B"), (5, "c"), (5, "C"), (4, "c"), (None, "d"), (6, "e")]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for letter, keep, n in (("a", None, 2), ("b", 3, 2), ("c", 5, 3), ("d", None, 1), ("e", 6, 1)):
        own = [r for r in got if r.text_sha256 == hashlib.sha256(letter.encode()).hexdigest()]
        assert len(own) == n and {(r.keep_id, r.group_size) for r in own} == {(keep, n)}
        assert [r.doc_id for r in own if r.kept] == [keep]


def test_a_filter_of_two_million_fingerprints_takes_seconds():
    prints = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 2_000_000)
    prints[::100] = prints[0]
    batches = (pa.RecordBatch.from_arrays([pa.array(prints[k : k + 2000])], ["fp"]) for k in range(0, len(prints), 2000))
    began = time.time()
    filters = [QuotientFilter.from_bytes(x) for b in _filters(4)(batches) for x in b.column(1).to_pylist()]
    assert time.time() - began < 20
    assert sum(f.counts.sum() for f in filters) == len(prints) and max(f.counts.max() for f in filters) == 20_000
