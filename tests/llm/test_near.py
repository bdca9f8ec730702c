import collections
import random

import numpy as np

from siltwork.llm import lshforest, near, paragraphs
from siltwork.llm.text import fold, word_hashes, words
from siltwork.operators.graph import components

SCHEMA = "doc_id long, text string"


def plain_sets(texts, width=5):
    out = {}
    for k, t in texts.items():
        w = words(t)
        n = min(width, len(w))
        out[k] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    return out


def plain_groups(sets, threshold=0.8):
    """Links and least members of components by comparing all pairs."""
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}, links


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    texts = {}
    for k in range(n):
        if k and rng.random() < 0.6:
            w = texts[rng.randrange(k)].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 40, 90]))]
        texts[k] = " ".join(w)
    return texts


def test_join_agrees_with_all_pairs(spark):
    texts = corpus()
    got = lshforest.join(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    root, links = plain_groups(plain_sets(texts))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {k: (root[k], links[k]) for k in texts}


def test_join_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (5, "x"), (6, "X")]
    df = spark.createDataFrame([(a, b, "h", 1) for a, b in rows], "doc_id long, text string, class_id string, n_links int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in lshforest.join(df).collect())
    assert got == [(-1, 4, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 5, 1), (6, 5, 1)]
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in lshforest.keep_one(df).collect())
    assert kept == [(1, None), (2, ""), (3, "!!"), (4, "a b c d e f"), (5, "x")]
    assert lshforest.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL_BLOCK", 300)
    rng = random.Random(5)
    base = [f"t{k}" for k in range(60)]
    texts = {}
    for k in range(90):
        w = list(base)
        w[rng.randrange(60)] = f"n{k}"
        texts[k] = " ".join(w)
    got = lshforest.join(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    root, links = plain_groups(plain_sets(texts))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {k: (root[k], links[k]) for k in texts}


def test_forest_shortens_until_its_recall(spark):
    rng = random.Random(11)
    texts, k = {}, 0
    for edits in (0, 1, 2, 2, 3, 3):
        for _ in range(25):
            base = [f"u{k}x{j}" for j in range(60)]
            other = list(base)
            for at in rng.sample(range(60), edits):
                other[at] = f"e{k}x{at}"
            texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
            k += 1
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    root, links = plain_groups(plain_sets(texts))
    whole, report = lshforest.join_with_report(df)
    assert {r.doc_id: (r.class_id, r.n_links) for r in whole.collect()} == {k: (root[k], links[k]) for k in texts}
    assert report["recall"] >= 0.9999 or report["depth"] == lshforest.shortest(0.8)
    # with a low target the longest prefixes do, and the estimate is near the truth
    loose = near.Near(groups=4, deepest=8, shortest=1, bytes_each=2, target=0.5)
    found, report = lshforest.join_with_report(df, loose)
    pairs = sum(links.values()) // 2
    got = sum(r.n_links for r in found.collect()) // 2
    copies = sum(texts[2 * k] == texts[2 * k + 1] for k in range(k))
    assert 0.5 <= report["recall"] and report["depth"] > 1
    assert abs(report["links"] / report["recall"] - (pairs - copies)) <= 0.25 * (pairs - copies) and got == report["links"] + copies


def test_no_link_is_no_evidence(spark):
    df = spark.createDataFrame([(k, " ".join(f"n{k}w{j}" for j in range(30))) for k in range(3)], SCHEMA)
    found, report = lshforest.join_with_report(df)
    assert report == {"depth": lshforest.shortest(0.8), "links": 0, "recall": 0.0}
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == [(k, k, 0) for k in range(3)]


def test_bounds_of_recall():
    assert near.recall_at(0.8, 24, lshforest.shortest(0.8)) >= 0.9999
    bands, rows = paragraphs.tuned(0.8)
    assert near.recall_at(0.8, bands, rows) >= 0.995


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 5000 + k) for k in range(200)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: r for x, r in up.items() if x in {y for a, b in edges if a != b for y in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_pieces(text):
    """(from, to, words) of the pieces, by the rule in words."""
    w, h = words(text), word_hashes(fold(text))
    none = (1 << 64) - 1
    g = [none] * len(w)
    for k in range(len(w) - 2):
        g[k] = int(paragraphs.mixed(h[k : k + 1] * np.uint64(3) + h[k + 1 : k + 2] * np.uint64(0x9E3779B97F4A7C15) + h[k + 2 : k + 3] * np.uint64(0xD6E8FEB86659FD93))[0]) >> 1
    reach = paragraphs.REACH
    starts = [k for k in range(len(w)) if k == 0 or g[k] < none and g[k] == min(g[max(0, k - reach) : k + reach + 1])]
    return [(a, z, tuple(w[a:z])) for a, z in zip(starts, [*starts[1:], len(w)]) if z - a >= paragraphs.SHORTEST]


def plain_dedup(texts, least_words):
    """doc_id -> (words that go, words of repeated passages)"""
    lines = {(k, j): x for k, t in texts.items() for j, x in enumerate((t or "").split("\n")) if words(x)}
    root, _ = plain_groups(plain_sets(lines))
    many = collections.Counter(root.values())
    holders = collections.defaultdict(set)
    for k, t in texts.items():
        for _, _, w in plain_pieces(t or ""):
            holders[w].add(k)
    out = {}
    for k, t in texts.items():
        n = len(words(t or ""))
        again, held = [False] * n, [False] * n
        at = 0
        for j, x in enumerate((t or "").split("\n")):
            m = len(words(x))
            if m and many[root[(k, j)]] > 1:
                for i in range(at, at + m):
                    (held if root[(k, j)] == (k, j) else again)[i] = True
            at += m
        for a, z, w in plain_pieces(t or ""):
            if len(holders[w]) > 1:
                for i in range(a, z):
                    (again if min(holders[w]) < k else held)[i] = True

        def counted(on):
            total, run = 0, 0
            for x in [*on, False]:
                if x:
                    run += 1
                else:
                    total += run if run >= least_words else 0
                    run = 0
            return total

        out[k] = counted(again), counted([a or b for a, b in zip(again, held)])
    return out


def test_paragraphs_agree_with_all_pairs(spark):
    rng = random.Random(3)
    pool = [t for t in corpus(7, 40).values()]
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {}
    for k in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.4 else " ".join(f"x{rng.randrange(3000)}" for _ in range(rng.choice([0, 2, 9, 30]))) for _ in range(rng.randrange(6))]
        if lines and rng.random() < 0.2:  # a passage within a line
            w = lines[0].split(" ")
            lines[0] = " ".join([*w[: len(w) // 2], passage, *w[len(w) // 2 :]])
        texts[k] = "\n".join(lines)
    texts |= {150: None, 151: ""}
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    for least in (1, 20):
        got = {r.doc_id: r for r in paragraphs.dedup(df, least_words=least).collect()}
        told = plain_dedup(texts, least)
        assert {k: (r.n_removed, r.n_repeated) for k, r in got.items()} == told
        for k, r in got.items():
            assert (r.text is None) == (texts[k] is None) and len(words(r.text)) == len(words(texts[k])) - r.n_removed
            if not r.n_removed:
                assert r.text == texts[k] and r.spans == ""
            assert all(f < k or least == 1 and f == k for f in r.kept_in)


def test_passages_within_lines_go(spark):
    passage = " ".join(f"word{k}" for k in range(70))
    rows = [(k, " ".join(f"a{k}b{j}" for j in range(30)) + " " + passage + " " + " ".join(f"c{k}d{j}" for j in range(30))) for k in range(5)] + [(9, "own words only. And a short line.\nAnd a short line.")]
    got = {r.doc_id: r for r in paragraphs.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_repeated >= 40 and got[9].n_repeated == got[9].n_removed == 0 and got[9].text == rows[5][1]
    for k in range(1, 5):
        assert got[k].n_removed >= 40 and got[k].n_passages == 1 and 0 in got[k].kept_in
        a, b = map(int, got[k].spans.split(":"))
        assert rows[k][1][:a] + rows[k][1][b:] == got[k].text and got[k].text.startswith(f"a{k}b0 ") and got[k].text.endswith(f"c{k}d29")


def test_lines_in_full(spark):
    nine, five = "one two three four five six seven eight nine", "a b c d e"
    rows = [(1, f"{nine}\n{five}\nyes\n\n!!"), (2, f"{five.upper()}\nnew\nYes.\n\n!!"), (3, f"zero {nine}\n{nine} ten eleven\n{nine}"), (4, "a b c d e f"), (None, five), (None, five)]
    df = spark.createDataFrame([(a, b, "t", 1) for a, b in rows], "doc_id long, text string, Kept_in string, n_words int")
    got = sorted((r.doc_id or 99, r.text, r.n_removed) for r in paragraphs.dedup(df, least_words=1).collect())
    # five of six shingles are shared with the line of ten words, five of seven with that of eleven
    assert got == [(1, rows[0][1], 0), (2, "new\n\n!!", 6), (3, f"{nine} ten eleven", 19), (4, "a b c d e f", 0), (99, "", 5), (99, "", 5)]
    passage = "\n".join(f"passage line {k} of eight words in all" for k in range(9))
    twice = paragraphs.dedup(spark.createDataFrame([(1, passage), (2, "own words\n" + passage)], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in twice} == {1: passage, 2: "own words"}
    assert paragraphs.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(150_000))
    texts = {1: long, 2: long + " end", 3: "short text of a few words only"}
    got = {r.doc_id: (r.class_id, r.n_links) for r in lshforest.join(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    cut = {r.doc_id: r.n_removed for r in paragraphs.dedup(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert cut == {1: 0, 2: 150_001, 3: 0}
