import random
import zlib

import numpy as np
import pytest

from siltwork.llm import balltree, html_text, langid, quality

WORDS = {"en": "the of and thing over under house", "de": "der und nicht über haus straße", "fr": "les et dans été maison être"}


def spoken(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(k, spoken(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 60)), lang, f"s{k % 3}") for k in range(300)]
    rows += [(1000, None, "en", "s"), (1001, "123 !!", "en", "s"), (1002, "", None, None), (None, "the house and the thing", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.digest(langid.identify(docs, langid.train(docs))).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and sum(g.held_out for g in got.values() if g.doc_id is not None and g.doc_id < 300) == len(held)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002)) and got[None].lang_pred == "en"
    assert all(0 <= g.score <= 1 for g in got.values())
    none = docs.limit(0)
    assert langid.identify(none, langid.train(none)).count() == 0


def test_quality_by_co_training(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        text = spoken(rng, "en", rng.randint(10, 80)).capitalize()
        rows.append((k, " ".join(w.upper() + "!!" for w in text.split()) if bad else text + ".", "en", f"s{k % 4}", 5, "x"))
        if k % 2 or k % 5 == 0 and k < 200:
            labels.append((k, int(not bad), 0))
    rows.append((999, None, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (5555, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab)
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(out) == len(rows)
    assert np.mean([out[k].rejected == (k % 5 == 0) for k in range(400)]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if not r.rejected}
    unlabelled = quality.train(docs, lab.limit(0))
    assert all(r.score == 0.5 and not r.rejected for r in quality.score(docs, unlabelled).collect())


@pytest.mark.parametrize("dim", [2, 16])
def test_top_k_agrees_with_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = rng.normal(0, 0.3, (400, dim)).round(2).astype(np.float32)
    vectors[100:200] = vectors[0]
    rows = [(int(k) * 5, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(9000, None), (9050, [1.0, None]), (9100, [float("nan")] * dim), (None, [0.1] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = balltree.top_k(df, df.filter("vec_id % 50 = 0"), shard_rows=100, block_rows=16).collect()
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, 400, 10):
        order = sorted((-int(whole[q] @ whole[k]), k * 5) for k in range(400) if k != q)[:5]
        want |= {(q * 5, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert balltree.top_k(df.limit(0), df.limit(0)).count() == 0


ARTICLE = "<article><h1>A title</h1><p>First &amp; long paragraph of the article, with <b>bold</b>\n words and enough of them.</p><p>Short.</p></article>"
WANT = "A title\nFirst & long paragraph of the article, with bold words and enough of them.\nShort."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><a>menu entry number one is long enough to surge</a></nav>{ARTICLE}<footer>&copy; foot</footer></body></html>", WANT),
        (f"<body><header>The head of the page, which is rather long as such heads go</header><div class='cookie-notice'>We use cookies on this page, click here to agree to it</div>{ARTICLE}<section id=comments><p>A reader's comment that is as long as a paragraph would be.</p></section>", WANT),
        (ARTICLE.replace("article>", "div>"), WANT),
        (f"<!-- <p>no</p> --><script>var a='<p>no</p>'</script>{ARTICLE[:-10]}", WANT),
        (None, ""), ("", ""), ("<p> </p>", ""), ("a < b", "a < b"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "word " * 40


@pytest.mark.parametrize(
    "page, last",
    [
        (f"<h1>Head line</h1><p>{LONG}</p><div class=ad><p>a</p><p>b</p><p>c</p><p>d</p></div><p>Short end.</p>", "Short end."),
        (f"<p>{LONG}</p><aside><ul><li>x<li>y<li>z<li>w</ul></aside><p>Short end.</p>", "Short end."),
        *[(f"<p>{LONG}</p><div {x}><p>{LONG} of a reader</p></div>", LONG.strip()) for x in ("class='discussion'", "class=reader-responses", "class=feedback-list", "class=adbox", "id=google_ads_1", "class=notice-box")],
        (f"<p>{LONG}</p><section id='menu-recipes'><p>{LONG}recipes</p></section>", LONG + "recipes"),
        (f"<p>{LONG}</p><div id='comments-on-budget'><p>{LONG}budget</p></div>", LONG + "budget"),
        (f"<p>{LONG}</p>" + "".join(f"<div><a href={k}>Link of some length {k}</a></div>" for k in range(5)), LONG.strip()),
    ],
)
def test_parts_and_links_part_the_text(page, last):
    assert html_text.main_text(page).split("\n")[-1] == last


def test_pages_are_read_in_time():
    import time

    for page in ("<!-" * 200_000, "<p>" * 100_000 + "x", "<div>" * 100_000 + "x", "a" * 3_000_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE, 3), (1, "u", ARTICLE, 3), (2, None, None, None)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
