import random
import re

from siltwork.llm import pii as P

TEXTS = [
    None, "", "mail a.b+c@ex-ample.co.uk, x@y and @z.com or a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.4 9999999999.1.1.1", "4808200777490071 4808-2007-7749-0071 4808200777490072 12 34",
    "call +1 (483) 555-1712 or +12 or +1234567. é +49 170 1234567 and (483) 555-1712 too", "clean text without any of it, version 3.",
]


def plain(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_agree():
    for t in TEXTS:
        assert P.base_spans(t or "") == plain(t or "")


def test_skip_edges_carry_labels(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, f"write to +1 ({200 + k}) 555-{1000 + k} today, or mail u{k}@mail.example.org. page {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.digest(P.find(docs, P.train(docs))).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        base = plain(t or "")
        assert [got[k][f"n_{x}"] for x in P.KINDS] == [sum(b[0] == n for b in base) for n in range(4)]
        assert {f"{P.KINDS[n]}:{a}:{b}" for n, a, b in base} <= set(got[k].spans.split(",")) | {""}
    at = TEXTS[5].rindex("(483)")
    assert f"phone:{at}:{at + 14}" in got[5].spans
    assert got[6].spans == ""
    none = docs.limit(0)
    assert P.find(none, P.train(none)).count() == 0


def test_repeats_share_what_is_known():
    field = P.SkipChainField().fit([f"write to +1 ({200 + k}) 555-{1000 + k} today. page {k} of 555-{1000 + k}" for k in range(50)] * 2)
    field.weights[:] *= 0.2  # where tokens alone decide less
    text = "write to +1 (299) 555-4321 today. so ask 555-4321 now"
    spans = P._tokens(text)
    p = field.marginals(text, spans)[-1, 3]
    field.skip[:] = 0
    assert p > field.marginals(text, spans)[-1, 3] + 0.05


def test_long_runs_are_read_in_time(spark):
    import time

    assert P.base_spans("0" * 5000 + ".1.1.1 and " + "9" * 5000 + ".1.1.1") == [(1, 0, 5006)]
    docs = spark.createDataFrame([(1, "0" * 5000 + ".1.1.1"), (2, "9" * 5000 + ".1.1.1"), (3, "1." * 5000)], "doc_id long, text string")
    assert [r.n_ip for r in P.digest(P.find(docs, P.train(docs))).orderBy("doc_id").collect()] == [1, 0, 1250]
    field = P.SkipChainField().fit(["mail a@b.org or +49 170 1234567 now"] * 20)
    for text in ("a" * 1_000_000, "7" * 1_000_000, "word " * 200_000 + "x@y.org", "a1" * 500_000):
        began = time.time()
        P.all_spans(text, field)
        assert time.time() - began < 20


def test_repeats_in_other_forms_are_added():
    """Numbers that the patterns find once and that stand again without the plus, or with other signs."""
    rng = random.Random(12)
    number = lambda: [f"{rng.randrange(100, 999)}" for _ in range(3)]
    written = lambda a, b, c: f"+49 {a} {b} {c}0"
    texts = []
    for k in range(400):
        n = number()
        texts.append(f"Item {k} of {rng.randrange(9000)}, call {written(*n)} today. Later on page {k} call {written(*n)} again or 20{rng.randrange(10, 24)}.")
    field = P.SkipChainField().fit(texts)
    hit = total = 0
    for k in range(60):
        n = number()
        text = f"Item {k}, call {written(*n)} today. Later call 49{''.join(n)}0 again, year 2019."
        base, every = P.all_spans(text, field)
        total += 1
        hit += any(kind == 3 and "49" + "".join(n) + "0" in text[a:b] for kind, a, b in every if (kind, a, b) not in base)
    assert hit >= 0.8 * total
