import collections
import math
import random

from siltwork.operators import textprof


def plain(weights, labels, margin=0.05):
    """Every document against the sum of every class without it."""
    sums = collections.defaultdict(collections.Counter)
    for d, own in weights.items():
        for t, w in own.items():
            sums[labels[d]][t] += w
    out = {}
    for d, own in weights.items():
        cosines = {}
        for c, s in sums.items():
            left = {t: v - (own.get(t, 0.0) if labels[d] == c else 0.0) for t, v in s.items()}
            size = math.sqrt(sum(v * v for v in left.values()))
            if set(own) & set(s):
                cosines[c] = sum(w * left.get(t, 0.0) for t, w in own.items()) / size if size > 1e-6 else 0.0
        best = max(cosines.values())
        nearest = min(c for c, v in cosines.items() if v >= best - 1e-12)
        gap = best - cosines.get(labels[d], 0.0)
        out[d] = (nearest, round(gap, 3), nearest != labels[d] and gap >= margin)
    return out


def test_nearest_classes_are_those_of_all(spark):
    rng = random.Random(3)
    classes = {f"c{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}word" for j in range(6)] for k in range(40)}
    common = ["alpha", "beta", "gamma", "delta", "omega"]
    rows, labels = [], {}
    for d in range(240):
        c = rng.choice(sorted(classes))
        labels[d] = rng.choice(sorted(classes)) if d % 9 == 0 else c
        rows.append((d, labels[d], " ".join(rng.choices(classes[c], k=rng.randint(1, 9)) + rng.choices(common, k=rng.randint(0, 4)) + rng.choices(rng.choice(list(classes.values())), k=2))))
    df = spark.createDataFrame(rows, "rid long, class string, text string")
    weights = collections.defaultdict(dict)
    for r in textprof.tfidf(df).collect():
        weights[r.rid][r.term] = r.weight
    want = plain(weights, labels)
    got = {r.rid: (r.nearest, round(r.margin, 3), r.suspected) for r in textprof.label_check(df).collect()}
    assert set(got) == set(want)
    for d, (nearest, gap, suspected) in want.items():
        assert got[d][0] == nearest and abs(got[d][1] - gap) < 2e-3 and got[d][2] == suspected


def test_only_the_result_stays_on_disk_and_sums_may_be_many(spark, monkeypatch):
    import os

    from siltwork.session import shared_folder

    words = ["red", "green", "blue", "round", "square", "flat"]
    rows = [(k, "ab"[k % 2], " ".join(words[(k + j * (1 + k % 3)) % 6] for j in range(5))) for k in range(40)]
    df = spark.createDataFrame(rows, "rid long, class string, text string")
    at = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    few = sorted(map(tuple, textprof.label_check(df).collect()))
    assert few and len(set(os.listdir(at)) - before) == 1
    monkeypatch.setattr(textprof, "FEW_SUMS", 0)
    assert sorted(map(tuple, textprof.label_check(df).collect())) == few
