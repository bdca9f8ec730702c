"""Models against plain versions of what they compute."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from siltwork.llm import html_text, langid, pii, quality, secrets
from siltwork.llm.arrow import share_of
from siltwork.llm.text import mixed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- language


def plain_subwords(text):
    raw = " " + "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.lower().encode()) + " "
    out = []
    for n in (3, 4, 5):
        for a in range(len(raw) - n + 1):
            w = raw[a : a + n]
            if " " not in w[1:-1] and (w[0] != " " or w[-1] != " "):
                total = sum(ord(c) * (pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j, c in enumerate(w)) + n
                out.append(int(mixed(np.array([total % (1 << 64)], np.uint64))[0]) >> (64 - langid.BITS))
    return out


def test_language_prediction_is_that_of_the_mean():
    rng = random.Random(3)
    words = {"en": "the of and thing over under house", "de": "der und nicht über haus straße", "fr": "les et dans été maison être"}
    texts = [(lang, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(2, 30)))) for lang in words for _ in range(40)]
    model = langid.LanguageModel(sorted(words)).fit([(lang, *langid.bag(t)) for lang, t in texts])
    for text in ["The HOUSE, and 12 things!", "der straße", "maison " * 300, "x"]:
        ids = plain_subwords(text)
        assert sorted(ids) == sorted(np.concatenate([langid.subwords(p) for p in langid.pieces(text)]).tolist())
        mean = np.sum([model.rows[k] for k in ids], axis=0) / max(1, len(ids)) * np.ones(16)
        z = (mean @ model.out + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, rejected = model.predict(text)
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4 and rejected == (score < model.least)


def test_texts_without_letters_are_undetermined():
    model = langid.LanguageModel(["de", "en"]).fit([(x, *langid.bag(t)) for x, t in [("de", "der und nicht"), ("en", "the of and")] * 20])
    for text in ("½ ² Ⅷ ① ٣", "12 _ -", "", None):
        assert model.predict(text)[0] == langid.UND
    assert model.predict("½ the of")[0] == "en"


def test_language_learning_does_not_depend_on_layout(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("the of and house der und nicht haus".split()) for _ in range(9)), "en" if k % 3 else "de", "s", 1) for k in range(200)] + [(900, "rare words here", "xx", "s", 1)]
    a, b = (langid.train(spark.createDataFrame(r, DOCS).repartition(n), sample_rows=60) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert a.languages == b.languages and "xx" in a.languages and np.array_equal(a.table, b.table) and a.temperature == b.temperature


# ---------------------------------------------------------------- personal data


def exact_marginals(field, text, spans):
    """By summing over all labellings."""
    unary = field.weights[pii._features(text, spans)].sum(axis=1)
    chain, skip = pii._edges(text, spans)
    n, k = unary.shape
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        s = sum(unary[i, x] for i, x in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
        for i, x in enumerate(labels):
            total[i, x] += math.exp(s)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text", ["call +1 (483) 555-1712 now", "write u1@x.org or 12 and then u1@x.org", "on 12.5.2020 555-1712-99 again 555 1712-99 x7", "a1@b.cc, 4"])
def test_marginals_are_exact_without_cycles_and_close_with_them(text):
    field = pii.SkipChainField().fit([f"write to +1 ({200 + k}) 555-{1000 + k} today or u{k}@mail.example.org. page {k} of 555-{1000 + k}" for k in range(60)])
    field.weights *= 0.3
    spans = pii._tokens(text)
    chain, skip = pii._edges(text, spans)
    exact, got = exact_marginals(field, text, spans), field.marginals(text, spans, rounds=200)
    cycles = len(chain) + len(skip) > len(spans) - 1
    assert np.abs(exact - got).max() < (0.2 if cycles else 2e-3)
    assert (exact.argmax(axis=1) == got.argmax(axis=1)).all()


def test_similar_tokens_are_linked():
    text = "555-123-4567 a (555)123.4567x b Jo.Doe@x.org c jo_doe@xorg and 555-123-4568"
    spans = pii._tokens(text)
    names = [text[a:b] for a, b in spans]
    linked = {(names[a], names[b]) for a, b in pii._edges(text, spans)[1]}
    assert ("Jo.Doe@x.org", "jo_doe@xorg") in linked and any("4567" in a and b == "555-123-4568" for a, b in linked)


def test_repeated_rows_and_extra_columns(spark):
    text = "mail a@b.org, token = abcdef123 and +49 170 1234567. " * 2
    docs = spark.createDataFrame([(1, text, 7, "x"), (1, text, 8, "y"), (2, None, 9, "z")], "doc_id int, text string, n_email int, spans string")
    for out in (pii.digest(pii.find(docs, pii.train(docs))), secrets.digest(secrets.scan(docs, secrets.train(docs)))):
        rows = [tuple(r) for r in out.orderBy("doc_id").collect()]
        assert len(rows) == 3 and rows[0] == rows[1] and rows[2][0] == 2
    long = ("word " * 200_000) + "x@y.org"
    assert pii.base_spans(long) == [(0, len(long) - 7, len(long))] and secrets.base_spans(long + " AKIA" + "A" * 16)[0][1:] == (1, len(long) + 21)


# ---------------------------------------------------------------- secrets


def plain_score(random_, ordinary, s, smooth=0.2):
    """Mean log-likelihood ratio from counts in dictionaries."""
    letters = secrets._ALPHABET
    n = len(letters) + 1

    def model(samples):
        three, two, one = {}, {}, {}
        for x in samples:
            codes = ["", "", *x]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                three[a, b, c] = three.get((a, b, c), 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
                one[b, c] = one.get((b, c), 0) + 1
        starts = {}
        for (b, c), v in one.items():
            starts[b] = starts.get(b, 0) + v

        def log(a, b, c):
            lower = (one.get((b, c), 0) + 1) / (starts.get(b, 0) + n)
            return math.log((three.get((a, b, c), 0) + smooth * n * lower) / (two.get((a, b), 0) + smooth * n))

        return log

    r, o = model(random_), model(ordinary)
    codes = ["", "", *s]
    return sum(r(a, b, c) - o(a, b, c) for a, b, c in zip(codes, codes[1:], codes[2:])) / len(s)


def test_ratio_is_that_of_plain_counts():
    random_, ordinary = secrets.drawn_strings(60, 4), ["getUserName", "max_count_value", "Wörter".replace("ö", "oe"), "----====", "a/b/c"]
    model = secrets.MarkovPair(random_, ordinary)
    for s in ["q7Zk2Lx9Vb4Rt8Wp1Ns6", "getUserNameAndCount", "-" * 20, "AAAA/BBBB+cc=="]:
        assert abs(model.score(s) - plain_score(random_, ordinary, s)) < 1e-9


UNSEEN = ["ledgerHarborTelescope", "fetch_invoice_ledger_17", "harbour-lantern-meadow", "CarpenterWindowFrames", "orchard/gravel/pebble9", "TELESCOPE_LENS_COATING", "marmaladeSandwichRecipe", "gewitterwolkenbruchartig"]


def test_names_never_trained_on_are_no_secrets(spark):
    parts = {p.lower() for s in UNSEEN for p in __import__("re").findall(r"[A-Z]?[a-z]+|[A-Z]+", s)}
    assert not parts & {*secrets.NAMES, *secrets.LONG_WORDS}
    model = secrets.train(spark.createDataFrame([], "doc_id long, text string"))
    assert [s for s in UNSEEN if model.score(s) > model.threshold] == []
    held = secrets.drawn_strings(2000, 77)
    assert sum(model.score(s) > model.threshold for s in held) > 0.85 * len(held)


# ---------------------------------------------------------------- quality


def test_logistic_is_at_the_least_of_its_loss():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(200, 5)), (rng.random(200) < 0.4).astype(float), rng.random(200)
    m = quality.Logistic(0.7).fit(x, y, w, steps=60)
    p = 1 / (1 + np.exp(-m.logit(x)))
    slope = (w * (p - y)) @ x + 0.7 * m.w[:-1]
    assert np.abs(slope).max() < 1e-3


def made_documents(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        bad = k % 5 == 0
        words = [rng.choice("the of and thing over under house".split()) for _ in range(rng.randint(8, 40))]
        text = "\n".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    return rows


def test_a_round_of_co_training_is_the_plain_one(spark):
    rows = made_documents(150)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(60)], "doc_id int, quality int, toxic int")
    got = quality.train(docs, labels, exchanged=20, rounds=1)
    view = {k: (quality.text_view(t), quality.record_figures(t, n), quality.record_names(lang, s)) for k, t, lang, s, n in rows}
    plain = quality.CoTrained().start([view[k] for k in range(60)], [float(k % 5 == 0) for k in range(60)])
    z = {k: plain.logits(view[k]) for k in range(60, 150)}
    few = max(1, round(20 * plain.bad_share))
    told = []
    share = {r[0]: r[1] for r in docs.select("doc_id", share_of(9, "doc_id")).collect()}
    for v in (0, 1):
        bad = sorted((k for k in z if z[k][v] > 1.5), key=lambda k: (-z[k][v], share[k]))[:few]
        good = sorted((k for k in z if z[k][v] < -1.5), key=lambda k: (z[k][v], share[k]))[: 20 - few]
        told.append({k: 1.0 for k in bad} | {k: 0.0 for k in good})
    new = sorted({*told[0], *told[1]})
    plain.exchange([view[k] for k in new], [{new.index(k): y for k, y in t.items()} for t in told])
    plain.finish()
    assert told[0] and abs(plain.threshold - got.threshold) < 1e-6
    for k in range(0, 150, 7):
        assert np.allclose(plain.score(view[k]), got.score(view[k]), atol=1e-6)


def test_views_share_no_figure():
    a, b = "Some words of the text.", "Quite other words here."
    assert quality.record_figures(a, 5) == quality.record_figures(b, 5)[:1] + quality.record_figures(b, 5)[1:] and not np.array_equal(quality.text_view(a), quality.text_view(b))
    assert quality.record_figures(a, 5) != quality.record_figures(a, 500) and not np.array_equal(quality.record_names("en", "a"), quality.record_names("en", None))


def test_quality_edge_cases(spark):
    rows = made_documents(80) + [(3, "again", "en", "s1", 5), (3, "again", "en", "s1", 5), (500, None, None, None, None), (None, "x " * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(50)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = [tuple(r) for r in quality.score(docs, model).collect()]
    assert len(out) == len(rows) and [r for r in out if r[0] == 3 and out.count(r) == 2]
    again = quality.train(docs.repartition(7), labels)
    assert again.threshold == model.threshold and np.array_equal(again.models[0].w, model.models[0].w)
    none = docs.limit(0)
    assert quality.score(none, quality.train(none, labels)).count() == 0 and quality.keep_good(none, model).columns == docs.columns
    clashing = docs.withColumnRenamed("n_chars", "Score").withColumn("names", docs["lang"])
    assert quality.keep_good(clashing, quality.train(clashing, labels)).columns == clashing.columns


# ---------------------------------------------------------------- pages

ARTICLE = "<article><h1>A title</h1><p>First &amp; long paragraph of the article, with <b>bold</b>\n words and enough of them.</p><p>Short.</p></article>"
WANT = "A title\nFirst & long paragraph of the article, with bold words and enough of them.\nShort."


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "entry header-fixed", "with-banner", "related-work", "blog-search", "sidebar", "comments"])
def test_no_page_loses_its_body_by_a_name(name):
    assert html_text.main_text(f'<body><nav>Menu</nav><div class="{name}">{ARTICLE}</div><footer>(c)</footer></body>') == WANT


def test_parts_of_pages():
    assert html_text.main_text(f"<body><form action=x><input name=q><nav>menu</nav>{ARTICLE.replace('article', 'div')}</form></body>") == WANT.replace("article", "div")
    assert html_text.main_text(ARTICLE.replace("<h1>A title</h1>", '<div class="entry-header"><h1>A title</h1></div>')) == WANT
    away = '<div class="sidebar"><p>A sidebar with a text that is as long as any paragraph would be.</p></div><div id="reader-comments"><p>A comment that is at least as long as the text of the article, if not longer.</p></div>'
    assert html_text.main_text(f"<body>{away}{ARTICLE}{away}</body>") == WANT
    tiny = '<div class="ad">An advert that is by far longer than the article is.</div><article><p>Tiny text.</p></article>'
    assert html_text.main_text(tiny) == "Tiny text."


def test_deep_nesting_takes_linear_time():
    import time

    began = time.time()
    assert html_text.main_text("<div>" * 100_000 + "text " * 30) == "text " * 29 + "text"
    assert html_text.main_text("<div class=ad>" * 50_000 + "text " * 30 + "</p></span>" * 50_000) in ("", "text " * 29 + "text")
    assert time.time() - began < 20


def plain_main_text(page):
    """Surge and dive over a list of lines told by hand: (text, part of the page); parts are no lines of the article, so
    that what follows one isn't lost for being short."""
    page = [(t, part) for t, part in page if not part]
    lengths = [len(t) for t, _ in page]
    out, k = [], 0
    while k < len(page):
        if lengths[k] and sum(lengths[k : k + html_text.WINDOW]) >= html_text.SURGE:
            while k < len(page) and sum(lengths[k : k + html_text.WINDOW]) > 0:
                if lengths[k]:
                    out.append(page[k][0])
                k += 1
        else:
            k += 1
    return "\n".join(out)


def test_runs_agree_with_plain_surges():
    rng = random.Random(6)
    for _ in range(200):
        page = [(" ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([1, 2, 12]))), rng.random() < 0.3) for _ in range(rng.randint(1, 25))]
        want = plain_main_text(page)
        if want:
            markup = "".join(f"<nav>{t}</nav>" if part else f"<p>{t}</p>" for t, part in page)
            assert html_text.main_text(f"<body>{markup}</body>") == want


def test_crc_tells_what_is_held_out(spark):
    ids = [0, 1, -5, 10**12, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(langid.held_out(__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id"))).collect()
    assert [r[0] for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
