import random

import corpus_pipeline
from siltwork.llm import decontaminate, secrets
from tests.llm.test_near import plain_groups, plain_sets


def test_stages_on_a_fixture(spark, tmp_path):
    """run() against what each stage must do, worked out plainly on its own input."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    item = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, labels = [], []
    for k in range(160):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60)))
        if k % 8 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif k % 8 == 1 and k > 8:
            text = rows[k - 7][1].replace("w1 ", "w2 ", 1)
        elif k % 8 == 2:
            text += f' {item} token = "{"0123456789abcdef" * 2}{k}"'
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(k % 8 != 0), 0))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(docs.columns[:5]) == {"doc_id", "text", "lang", "source", "n_chars"}
        if k == 0:
            assert set(after) == {r[0] for r in rows if r[0] % 8}
        elif k == 1:
            root, _ = plain_groups(plain_sets({i: r.text for i, r in before.items()}))
            assert set(after) == set(root.values())
        elif k == 2:
            told = decontaminate.brute_force([(i, r.text) for i, r in before.items()], [(1, item)])
            assert all(after[i] == r for i, r in before.items() if not told[i][4])
            assert not any(x[4] for x in decontaminate.brute_force([(i, r.text) for i, r in after.items()], [(1, item)]).values())
        elif k == 3:
            assert set(after) == set(before) and not any(secrets.base_spans(r.text) for r in after.values())
            assert all(after[i].text == r.text for i, r in before.items() if not secrets.base_spans(r.text))
        else:
            assert set(after) <= set(before) and all(0 < r.mix_words <= 3 * len(r.text.split()) for r in after.values())
    assert {(r.doc_id, r.mix_words) for r in corpus_pipeline.run(spark, d).collect()} == {(i, r.mix_words) for i, r in after.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, Spans string, class_id long, h string"


def run_stages(spark, docs, d):
    """(name, rows before, rows after) of each stage, written and read between them."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, d).write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        yield name, before, docs.collect(), docs.columns


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(300)]
    item = " ".join(vocabulary[:25])
    texts = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(60)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    rows += [(100, " ".join(w.upper() + "!!" for w in t.split()), "en", "s0", 9) for t in texts[:1]]
    rows += [(7, texts[7], "en", "s1", 5)] * 2 + [(None, texts[8], "en", "s0", 5), (None, texts[9] + " more", None, None, None), (None, "no id and no twin at all", "en", "s0", 1)]
    rows += [(9, texts[9] + " again", "en", "s0", 1), (200, None, None, None, None), (201, "", "en", None, 0), (202, "...", "en", "s0", 3), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(203, f"{texts[0]} x {item} y {texts[1]}", "en", "s1", 5), (204, item, "en", "s1", 5), (205, "token = abcdef123456 " + texts[2], "en", "s1", 5), (206, "z" * 300_000 + " " + texts[3], "en", "s0", 5)]
    more = (1, "x", 2, "y")
    d = str(tmp_path)
    spark.createDataFrame([r + more for r in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 100 != 0 or k == 0), 0) for k in [*range(60), 100]] + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, ""), (1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, before, after, columns in run_stages(spark, spark.read.parquet(f"{d}/documents.parquet"), d):
        assert columns[:9] == [c.split()[0] for c in SCHEMA.split(", ")]
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
        if name == "quality classifier":
            assert {key(r) for r in after} <= {key(r) for r in before} and {r.doc_id for r in after} >= set(range(60))
        elif name == "n-gram Jaccard join":
            units = {i: r for i, r in enumerate(before)}
            root, _ = plain_groups(plain_sets({i: r.text or "" for i, r in units.items()}))
            groups = {}
            for i in units:
                groups.setdefault(root[i], []).append(units[i])
            # the least id stays, those without one last; rows without a word all stay
            want = sorted(min(((r.doc_id is None, r.doc_id or 0) for r in g)) for g in groups.values())
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == want
        elif name == "benchmark decontamination":
            told = decontaminate.brute_force([(i, r.text) for i, r in enumerate(after)], [(1, item)])
            assert not any(x[4] for x in told.values())
            clean = decontaminate.brute_force([(i, r.text) for i, r in enumerate(before)], [(1, item)])
            assert sorted(key(r) for i, r in enumerate(before) if not clean[i][4]) == sorted(key(r) for r in after if r.doc_id != 203)
        elif name == "secret scans":
            assert len(after) == len(before) and not any(secrets.base_spans(r.text or "") for r in after)
        else:
            assert all(0 < r.mix_words <= 3 * len((r.text or "").split()) for r in after) and len(after) <= len(before)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, _, after, columns in run_stages(spark, docs, d):
        assert after == [] and columns[:9] == docs.columns
    assert corpus_pipeline.run(spark, d).count() == 0
