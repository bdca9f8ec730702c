"""Hard negatives, nearest vectors and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siltwork.llm import bitslice, impacts, projections

VECTORS = "vec_id long, embedding array<double>, label int, score string"


def usable(v, scale=1.0):
    return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v)


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, anchors, positives, negatives, low, high):
    cut = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    whole = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if i is not None and y is not None and usable(v, 256)]
    out = []
    own = {(i, tuple(v), y) for i, v, y in whole if i in anchors}
    for a, v, y in sorted(own):
        scored = [(-cut(sum(p * q for p, q in zip(v, w))), i, z) for i, w, z in whole if i != a and len(w) == len(v)]
        best = sorted((s, i) for s, i, z in scored if z == y)[:positives]
        for s, p in best:
            fits = sorted((t, i) for t, i, z in scored if z != y and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def vectors_with_faults(seed, n=220, dim=6):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 0.3) + 0.2 for _ in range(dim)], rng.randrange(3), f"s{k}") for k in range(n)]
    rows += [(k + 1000, rows[7][1], k % 3, "tie") for k in range(30)]  # equal vectors: ties by id
    rows += [(20, rows[20][1], 1, "again"), (20, rows[21][1], 2, "other"), rows[5], rows[40], (None, rows[3][1], 1, None)]
    rows += [(2000, None, 1, ""), (2001, [0.1, None, 0.2, 0.3, 0.1, 0.2], 1, ""), (2002, [float("nan")] * dim, 1, ""), (2003, [float("inf")] * dim, 1, ""), (2004, rows[1][1], None, "")]
    return rows + [(2005, [], 1, ""), (2010, [], 1, ""), (2020, [], 2, ""), (2011, [0.5, 0.5], 1, ""), (2012, [0.5, 0.25], 2, ""), (2040, [0.75, 0.5], 1, "")]


@pytest.mark.parametrize("seed, shard_rows, chunk", [(1, 64, 16), (2, 100000, 1024)])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, seed, shard_rows, chunk):
    monkeypatch.setattr(bitslice, "CHUNK", chunk)
    rows = vectors_with_faults(seed)
    df = spark.createDataFrame(rows, VECTORS)
    found = bitslice.mine(df, df.filter("vec_id % 20 = 0"), positives=4, negatives=3, shard_rows=shard_rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, {i for i, *_ in rows if i is not None and i % 20 == 0}, 4, 3, 30, 90)


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([1e14, -3e13, 2e300, 5.0, 0.0]) for _ in range(3)], k % 2, "") for k in range(24)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, bitslice.mine(df, df.filter("vec_id < 6")).collect())) == plain_negatives(rows, set(range(6)), 5, 10, 30, 90)
    assert bitslice.mine(df.limit(0), df.limit(0)).count() == 0 and bitslice.mine(df, df.limit(0)).count() == 0


def test_intervals_tighten_to_exact_scores():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 2000)).astype(float)  # long vectors
    q = rng.integers(-300, 300, (4, 2000)).astype(float)
    span = np.array([[-(2**63)], [-2_000_000], [0], [1]]), np.array([[2**63 - 1], [1_000_000], [0], [-1]])
    queries = bitslice.Queries(np.full(4, -1), np.zeros(4, int), q, *span)
    r, w, i, s = bitslice.top_in_windows(queries, np.arange(500), np.zeros(500, int), x, 7, True)
    for n in range(4):
        every = sorted((-int(v), k) for k, v in enumerate(x @ q[n]) if span[0][n, 0] <= v <= span[1][n, 0])[:7]
        assert [(-b, a) for a, b in zip(i[r == n], s[r == n])] == every


# ---------------------------------------------------------------- nearest vectors


def plain_nearest(rows, queries, k):
    own = [(i, v) for i, v, *_ in rows if i is not None and usable(v) and any(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in own if i in queries}:
        def product(w):
            total = 0.0
            for a, b in zip(v, w):
                total += a * b
            return total

        best = sorted((-product(w), i) for i, w in own if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [64, 100000])
def test_nearest_with_a_certain_radius_are_those_of_all_pairs(spark, shard_rows):
    rows = [r for r in vectors_with_faults(6) if not (r[0] == 20 and r[3] == "other")] + [(2050, [0.0] * 6, 1, "")]
    df = spark.createDataFrame(rows, VECTORS)
    found = projections.nearest(df, df.filter("vec_id % 20 = 0"), k=9, sure=1 - 1e-12, shard_rows=shard_rows)
    assert sorted(map(tuple, found.collect())) == plain_nearest(rows, {i for i, *_ in rows if i is not None and i % 20 == 0}, 9)
    assert projections.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_reaches_its_recall_and_splits_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.2, 3, (3000, 1))  # norms differ
    x[1000:1900] = x[999]  # a third are copies
    rows = [(k, v.tolist(), 0, "") for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = projections.nearest(df, df.filter("vec_id % 20 = 0"), k=20, shard_rows=256).toPandas()
    hit = 0
    for q, own in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(own["rank"]) == list(range(1, 21)) and own["vec_id"].is_unique
        hit += int((s[own["vec_id"]] >= np.sort(s)[-20] - 1e-9).sum())
    assert found["query_id"].nunique() == 150 and hit >= 0.9 * 150 * 20


def test_chi_square():
    for axes, x, want in [(2, 2.0, 1 - math.exp(-1)), (1, 1.0, 0.6826894921), (10, 18.307038, 0.95), (5, 11.0704977, 0.95)]:
        assert abs(float(projections.chi_square(np.array(x), axes)) - want) < 1e-7
        assert abs(projections.chi_square_at(want, axes) - x) < 1e-4


def test_cells_within_a_radius_hold_all_rows_within_it():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((600, 3))
    splits = projections.Splits(points, 32)
    cell = splits.cell(points)
    assert len(set(cell)) == splits.leaves == 32
    for p in rng.standard_normal((40, 3)) * 2:
        for r in (0.3, 1.0, 2.5):
            near = np.flatnonzero(((points - p) ** 2).sum(axis=1) <= r * r)
            assert set(cell[near]) <= set(splits.within(p, r * r))


# ---------------------------------------------------------------- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_rank(docs, items, k):
    bags = [(i, Counter(w.translate(LOWER) for w in TERM.findall(t))) for i, t in docs if t is not None]
    bags = [(i, c) for i, c in bags if c]
    n_docs, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(w for _, c in bags for w in c)
    out = []
    for item, text in items:
        own = Counter(w.translate(LOWER) for w in TERM.findall(text or ""))
        scored = []
        for i, c in bags:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, times in own.items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, n, i))
        out += [(item, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def library(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "naïve", "ÜBER", "of", "THE"]
    docs = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(65)], k=rng.randrange(1, 60)))) for k in range(300)]
    docs += [(k + 500, docs[9][1]) for k in range(40)] + [docs[3], docs[3], (None, docs[4][1]), (None, "w1 w2"), (900, None), (901, ""), (902, "?! ,"), (903, "w1," * 9000)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(30)]
    return docs, items + [("i3", "w1 w1 the"), (None, "w2 über-äpfel"), ("none", None), ("empty", ".."), ("unknown", "zzz"), ("long", "w5 " * 400)]


@pytest.mark.parametrize("seed, part_terms, batch", [(1, 1 << 18, 2048), (2, 150, 32)])
def test_ranks_are_those_of_all_documents(spark, monkeypatch, seed, part_terms, batch):
    monkeypatch.setattr(impacts, "BATCH", batch)
    monkeypatch.setattr(impacts, "ITEMS", 7)
    monkeypatch.setattr(impacts, "PIECE", 64)
    docs, items = library(seed)
    left = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    found = impacts.rank(left, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, score int"), k=8, part_terms=part_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_rank(docs, items, 8)


def test_ranks_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id string, text string"))
    one = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert impacts.rank(docs, one).count() == 0 and impacts.rank(docs, items).count() == 0
    assert impacts.rank(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items).count() == 0


def test_bytes_bound_impacts(spark):
    rows = [(k, n, [0], [tf]) for k, (n, tf) in enumerate((n, tf) for n in (1, 7, 500, 90000) for tf in (1, 2, 9, 500) if tf <= n)]
    index = bitslice_rows(impacts.with_impacts(spark.createDataFrame(rows, "doc_id long, n long, term array<int>, tf array<long>"), 1000, 77777))
    for n, tf, m, byte in index:
        assert m == 75 + 25 * n * 1000 // 77777
        exact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        assert 1 <= byte <= 255 and (byte - 1) * impacts.QUANTUM <= exact <= byte * impacts.QUANTUM


def bitslice_rows(index):
    return [(r["n"], r["tf"][0], r["m"], r["byte"][0]) for r in index.collect()]
