from pyspark.sql import functions as F

from siltwork.operators import near
from siltwork.operators.graph import components
from siltwork.operators.near import near_audio_groups, near_image_groups, near_text_groups, near_text_pairs
from siltwork.operators.registry import apply_op


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {100: 100, 101: 100}


def docs(spark):
    base = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, "a", base), (2, "b", base.upper()), (3, "a", base + " tail"), (4, "a", "other words stand here"), (5, "", ""), (6, "", None)]
    return spark.createDataFrame(rows, "rid long, class string, text string")


def test_text_groups(spark):
    d = docs(spark)
    assert [(r.a, r.b) for r in near_text_pairs(d).collect()] == [(1, 3)]
    assert {r.id: r.label for r in near_text_groups(d).collect()} == {1: 1, 2: 1, 3: 1}
    assert sorted(r.rid for r in apply_op(d, "text", "drop_near_duplicates").collect()) == [1, 4, 5, 6]
    assert sorted(r.rid for r in apply_op(d, "text", "drop_cross_label_duplicates").collect()) == [4, 5, 6]


def test_media_groups(spark):
    images = spark.createDataFrame([(1, "f000000000000001", "0a0a"), (2, "f000000000000003", "0b0a"), (3, "f000000000000003", "ffff"), (4, "0fffffffffffffff", "0a0a")], "rid long, phash string, thumb string")
    assert {r.id: r.label for r in near_image_groups(images).collect()} == {1: 1, 2: 1}
    clips = spark.createDataFrame([(1, 10.0, "1020"), (2, 10.1, "1121"), (3, 12.0, "1020"), (4, None, "1020")], "rid long, duration double, signature string")
    assert {r.id: r.label for r in near_audio_groups(clips).collect()} == {1: 1, 2: 1}
    assert clips.filter(F.col("rid") > 9).transform(lambda d: near_audio_groups(d)).count() == 0


def plain_groups(ids, linked):
    """Least ids of the components of all linked pairs, of two rows and more."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if root(a) != root(b) and linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    label = {i: root(i) for i in ids}
    often = {v for v in label.values() if sum(w == v for w in label.values()) > 1}
    return {i: v for i, v in label.items() if v in often}


def test_groups_of_a_hot_band_in_cells(spark, monkeypatch):
    """Near copies that all share bands, of which the head is linked to few only, so that cells have to find the ties."""
    import random

    from siltwork.operators import linkage

    monkeypatch.setattr(linkage, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)]
    texts = {}
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 9])):
            w[rng.randrange(90)] = f"y{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
        texts[k] = " ".join(w)
    texts |= {150 + k: " ".join(rng.sample(base, 60)) for k in range(20)} | {200: texts[3], 201: texts[9].upper(), 202: "", 203: None}
    sets = {k: {tuple(w[a : a + 3]) for w in [t.lower().split()] for a in range(max(1, len(w) - 2))} for k, t in texts.items() if t}
    df = spark.createDataFrame(list(texts.items()), "rid long, text string").repartition(3)
    got = {r.id: r.label for r in near_text_groups(df).collect()}
    assert got == plain_groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    pairs = {(r.a, r.b) for r in near_text_pairs(df).collect()}
    own = [k for k in sorted(sets) if not any(sets[k] == sets[j] for j in sets if j < k)]
    assert pairs == {(a, b) for a in own for b in own if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_one_band_of_many_near_copies_needs_no_cells(spark):
    from siltwork.operators import linkage

    base = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    n = 20000
    df = spark.range(n).select(F.col("id").alias("rid"), F.concat(F.lit(base + " z"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    first = near_text_groups(df)
    assert first.count() == n and first.filter("label <> 0").isEmpty()
    plan = first._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and linkage.BLOCK < n


def test_media_groups_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from siltwork.operators import linkage
    from siltwork.operators.near import near_video_groups

    monkeypatch.setattr(linkage, "BLOCK", 8)
    rng = random.Random(9)
    clips = {}
    for k in range(160):
        if k % 3 and k > 5:
            d, s = clips[rng.randrange(k)]
            clips[k] = (d * rng.choice([1, 1.01, 1.019, 0.97]), bytes(min(255, max(0, b + rng.randint(-4, 4))) for b in s))
        else:
            clips[k] = (rng.choice([2.0, 2.0, 3.1, 50.0]), bytes(rng.randrange(256) for _ in range(rng.choice([8, 8, 8, 12]))))
    df = spark.createDataFrame([(k, d, s.hex()) for k, (d, s) in clips.items()] + [(900, None, "00"), (901, 2.0, None), (902, 0.0, "00"), (903, 2.0, "zz"), (904, 2.0, "")], "rid long, duration double, signature string")

    def linked(most, tolerance):
        def one(a, b):
            (x, s), (y, t) = clips[a], clips[b]
            return len(s) == len(t) and abs(x - y) <= tolerance * max(x, y) and sum(abs(p - q) for p, q in zip(s, t)) / len(s) <= most
        return one

    assert {r.id: r.label for r in near_audio_groups(df).collect()} == plain_groups(list(clips), linked(3.0, 0.02))
    assert {r.id: r.label for r in near_video_groups(df).collect()} == plain_groups(list(clips), linked(6.0, 0.05))


def test_signatures_estimate_similarity(spark):
    sets = [(k, list(range(1000 * k, 1000 * k + 200)), list(range(1000 * k + d, 1000 * k + 200 + d))) for k, d in enumerate((0, 20, 100, 200))]
    df = spark.createDataFrame(sets + [(9, [], [])], "k int, a array<bigint>, b array<bigint>")
    hashed = df.select("k", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("a", "b")])
    signed = hashed.select("k", *[near.minhash(F.col(c), 256).alias(c) for c in ("a", "b")])
    got = {r.k: r.s for r in signed.select("k", near.signature_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[0] == 1.0 and got[9] == 0.0
    for k, d in enumerate((0, 20, 100, 200)):
        assert abs(got[k] - (200 - d) / (200 + d)) <= 0.15


def test_signatures_stand_in_few_cells_and_are_compared_in_parts(spark, monkeypatch):
    import random

    from siltwork.operators import linkage

    rng = random.Random(3)
    clips = {k: bytes(rng.randrange(100, 140) for _ in range(16)) for k in range(120)}
    clips |= {200 + k: bytes(b + rng.randint(-3, 3) for b in clips[k]) for k in range(120)}
    df = spark.createDataFrame([(k, 2.0, s.hex()) for k, s in clips.items()], "rid long, duration double, signature string")
    keys = df.select(F.size(near.signature_cells(F.col("duration"), F.unhex("signature"), 3.0, 0.02)).alias("n"))
    assert keys.agg(F.avg("n")).first()[0] < 6  # 16 of them made a table many times the input
    monkeypatch.setattr(linkage, "AT_A_TIME", 50)
    monkeypatch.setattr(near, "SHORT", 1)
    monkeypatch.setattr(linkage, "BLOCK", 16)
    got = {r.id: r.label for r in near_audio_groups(df).collect()}
    assert got == plain_groups(sorted(clips), lambda a, b: sum(abs(x - y) for x, y in zip(clips[a], clips[b])) <= 48)


def test_few_pairs_of_signatures_are_compared_byte_by_byte(monkeypatch):
    import numpy as np
    import pandas as pd

    from siltwork.operators import linkage

    monkeypatch.setattr(near, "LEAF", 64)
    rng = np.random.default_rng(4)
    for n, spread, most, share in ((16, 12, 3.0, 0.01), (16, 12, 6.0, 1), (1, 40, 3.0, 1), (5, 20, 3.0, 0.02), (300, 30, 3.0, 0.02)):
        a = np.clip(np.rint(rng.normal(128, spread, (400, n))), 0, 255).astype(int)
        b = np.clip(np.concatenate([a[:300] + rng.integers(-5, 6, (300, n)), rng.normal(128, spread, (200, n))]), 0, 255).astype(int)
        left, right = (
            pd.DataFrame({"id": at + np.arange(len(x)), "label": at + np.arange(len(x)), "d": rng.choice([2.0, 2.03, 2.2], len(x)), "s": [r.astype(np.uint8).tobytes() for r in x]})
            for x, at in ((a, 0), (b, 1000))
        )
        d, e = left["d"].to_numpy()[:, None], right["d"].to_numpy()[None, :]
        want = (np.abs(a[:, None] - b[None]).sum(2) / n <= most) & (np.abs(d - e) <= 0.02 * np.maximum(d, e))
        assert want.any()
        parts, check = near.signature_sieve(left, right, most, 0.02)
        got, met = set(), 0
        for i, j in parts:
            met += len(i)
            hit = check(i, j)
            got |= set(zip(i[hit].tolist(), j[hit].tolist()))
        assert got == set(zip(*(x.tolist() for x in np.nonzero(want)))) and met <= share * want.size
        ties = linkage.tie_blocks(left, right, lambda x, y: near.signature_sieve(x, y, most, 0.02))
        assert sorted(ties) == sorted(linkage.tie_blocks(left, right, linkage.sifted(lambda x, y: want[x.index[0] : x.index[-1] + 1])))


def test_audio_drop_in_small_leaves_and_blocks_agrees_with_all_pairs(spark, monkeypatch):
    import random

    from siltwork.operators import linkage

    rng = random.Random(5)
    clips = {k: bytes(rng.randrange(90, 166) for _ in range(16)) for k in range(150)}
    clips |= {200 + k: bytes(b + rng.randint(-4, 4) for b in clips[k]) for k in range(100)}
    for name, value in (("LEAF", 8), ("SHORT", 4), ("FINE", 1)):
        monkeypatch.setattr(near, name, value)
    monkeypatch.setattr(linkage, "BLOCK", 16)
    df = spark.createDataFrame([(k, 2.0, s.hex()) for k, s in clips.items()], "rid long, duration double, signature string")
    groups = plain_groups(sorted(clips), lambda a, b: sum(abs(x - y) for x, y in zip(clips[a], clips[b])) <= 48)
    assert len(groups) > 150
    got = {r.rid for r in apply_op(df, "audio", "drop_near_duplicates").select("rid").collect()}
    assert got == {k for k in clips if groups.get(k, k) == k}
