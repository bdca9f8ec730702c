import random

import pytest
from pyspark.sql import Row

from siltwork.llm import mixing


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Share by weight, cut at the caps, share the excess again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] for s in capped} | share
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    names = [None, "b", "a", "é", "zz", "c"]
    rows = [Row(doc_id=k, text=" ".join("w" * rng.randint(1, 3) for _ in range(int(rng.expovariate(1 / 40)))), source=rng.choice(names[: 3 + seed] if rng.random() < 0.3 else names[:1])) for k in range(400)]
    rows += [Row(doc_id=9999, text="x y z", source="b")] * 5 + [Row(doc_id=None, text=None, source="a")]
    got = mixing.mix_sources(spark.createDataFrame(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        # the rest is shared by size between equal hashes, rounded down
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1 + 5
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, size string, target int")
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "a b", None, "s", 3, 1, 2, 5)], "doc_id long, text string, source string, size string, target int, h int, d int, mix_words int")
    out = mixing.mix_documents(one).collect()
    assert [(r.size, r.h, r.d, r.mix_words) for r in out] == [("s", 1, 2, 2)]
