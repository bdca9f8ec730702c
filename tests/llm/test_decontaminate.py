import random

from siltwork.llm import decontaminate as D

SCHEMA = "doc_id long, text string"


def cases(seed=1):
    rng = random.Random(seed)
    vocabulary = list("abcdefgh")
    items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([3, 9, 10, 11, 25, 40, 1])] + [("n", None), ("e", "!!"), (None, "a b c d")]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(80)]
    for k in range(80, 140):
        w = items[rng.randrange(6)][1].split()
        a = rng.randrange(len(w))
        docs.append((k, f"X y, {' - '.join(w[a:]).upper()} {docs[k - 80][1]}"))
    return docs + [(140, None), (141, ""), (142, "é"), (142, "a b c d")], items


def test_scan_agrees_with_all_windows(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    want = [D.brute_force([x], items)[x[0]] for x in docs]
    for part_words in (D.PART_WORDS, 20):
        got = D.digest(D.mark(d, i, part_words=part_words)).collect()
        assert sorted((r.doc_id, tuple(r)[1:]) for r in got) == sorted((x[0], w) for x, w in zip(docs, want))


def test_decontaminate_leaves_nothing_and_keeps_clean(spark):
    docs, items = cases(3)
    d, i = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    got = D.decontaminate(d, i, max_coverage=1.0).collect()
    assert len(got) == len(docs)
    clean = {x for x in docs if not D.brute_force([x], items)[x[0]][4]}
    assert clean <= {tuple(r) for r in got}
    assert not any(D.brute_force([tuple(r)], items)[r.doc_id][4] for r in got)
    few = D.decontaminate(d, i, max_coverage=0.3).collect()
    assert clean <= {tuple(r) for r in few} and len(few) < len(got)


def test_empty(spark):
    d, i = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in D.digest(D.mark(d, i)).collect()] == [(2, False)]
    assert D.digest(D.mark(d.limit(0), i)).count() == 0
    extra = d.selectExpr("*", "7 AS n_chars", "'s' AS spans")
    assert [tuple(r) for r in D.decontaminate(extra, i).collect()] == [(1, "a b", 7, "s")]


def test_parts_change_nothing(spark):
    items = [(str(k), " ".join(f"i{k}w{j}" for j in range(20))) for k in range(8)]
    own = " ".join(f"o{j}" for j in range(10))
    docs = [(k, f"{items[k][1]} {own} {items[(k + 1) % 8][1]}") for k in range(8)]  # 80% hit, 40% by each of two items
    for k in range(8):  # cutting one item joins the halves of another
        a, b = items[k][1].split(), items[(k + 1) % 8][1]
        docs.append((8 + k, f"{' '.join(a[:9])} {b} {' '.join(a[9:18])} {' '.join([own] * 6)}"))
    extra, more = cases(5)
    docs += [(100 + (k or 0), t) for k, t in extra]
    d = spark.createDataFrame([(k, t, len(t or "")) for k, t in docs], f"{SCHEMA}, n_chars int")
    i = spark.createDataFrame(items + more, "item_id string, text string")
    for limit in (0.5, 1.0):
        one, many = ([tuple(r) for r in D.decontaminate(d, i, max_coverage=limit, part_words=p).collect()] for p in (D.PART_WORDS, 60))
        assert len(D.item_parts(i, 60)) > 1
        assert sorted(one, key=str) == sorted(many, key=str)
        assert limit == 1.0 or not any(r[0] < 8 for r in many)
