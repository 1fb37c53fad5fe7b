import random

import pytest

from tesselune.llm import components
from tesselune.llm.common import Scratch


def expected(pairs):
    label = {v: v for p in pairs if p[0] != p[1] for v in p}
    while True:
        old = dict(label)
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == old:
            return label


@pytest.mark.parametrize("held", [0, 1 << 17])
def test_one_task_and_joins_give_the_same_labels(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(held)
    path = [(k, k + 1) for k in range(100, 160)]
    pairs = path + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(7, 7), (500, 500), (-3, 200), (200, 300)]
    pairs = pairs[::-1] + pairs[:5]
    t = Scratch(spark)
    links = t.counted(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    out = components.components(links, t.size(links), t)
    got = [(r.v, r.label) for r in out.collect()]
    assert len(got) == t.size(out) and dict(got) == expected(pairs)
    none = t.counted(links.where("a > 1000"))
    assert t.size(none) == 0 and components.components(none, 0, t).count() == 0


def test_few_links_take_one_job_to_join(spark, monkeypatch):
    """A path of many links was a shuffle and a written table a round; few links are one table."""
    t = Scratch(spark)
    links = t.counted(spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long").repartition(4))
    before = t.made
    assert {r.label for r in components.components(links, t.size(links), t).collect()} == {0}
    assert t.made == before + 1
