import random

import numpy as np
from pyspark.sql import functions as F

from siltwork.operators import textprof


def test_topics_share_all_documents(spark):
    rng = random.Random(1)
    words = {"a": "ship sail harbour wind wave anchor", "b": "bread flour oven yeast crust dough", "c": "goal team score match field player"}
    rows = [(k, " ".join(rng.choice(words["aabc"[k % 4]].split()) for _ in range(12))) for k in range(120)]
    found = textprof.topics(spark.createDataFrame(rows, "rid long, text string"), k=3)
    assert sorted(t["share"] for t in found) == [0.25, 0.25, 0.5]
    assert sorted(sorted(t["words"]) for t in found) == sorted(sorted(w.split()) for w in words.values())
    assert textprof.topics(spark.createDataFrame([(1, ""), (2, None)], "rid long, text string"), k=2) == []


def plain_factors(m, k, rounds, seed):
    """Each entry times the ratio of the two parts of its gradient, on the whole dense matrix."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((m.shape[0], k)) + 0.1, rng.random((k, m.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ m) / (w.T @ w @ h + 1e-9)
        w *= (m @ h.T) / (w @ h @ h.T + 1e-9)
    return ((m - w @ h) ** 2).sum()


def test_residual_is_that_of_a_dense_factorisation(spark):
    rng = np.random.default_rng(4)
    m = (rng.random((90, 4)) ** 4 @ rng.random((4, 60)) ** 4) + 0.05 * rng.random((90, 60)) * (rng.random((90, 60)) < 0.3)
    m[m < 0.02] = 0
    cells = [(int(i), f"t{j:02d}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    weights = spark.createDataFrame(cells, "rid long, term string, weight double").repartition(5)
    places = spark.createDataFrame([(f"t{j:02d}", j) for j in range(60)], "term string, place int")
    rows = textprof.SparseRows(weights, "rid", places)
    h, left = textprof.factorise(rows, 4, 60)
    dense = min(plain_factors(m, 4, 500, s) for s in range(3))
    assert (h >= 0).all() and left <= 1.01 * dense
    told = rows.topic(h).agg(F.count("*"), F.min("share"), F.max("share")).first()
    assert told[0] == len({c[0] for c in cells}) and 0.25 <= told[1] <= told[2] <= 1


def test_nonnegative_least_squares():
    rng = np.random.default_rng(6)
    h = rng.random((3, 9))
    v = rng.standard_normal((20, 9))
    w = textprof.nonnegative(h @ h.T, v @ h.T)
    slope = (w @ h - v) @ h.T
    assert (w >= 0).all() and (slope[w == 0] >= -1e-6).all() and np.abs(slope[w > 0]).max() < 1e-6
