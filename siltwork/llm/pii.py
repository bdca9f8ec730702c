"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

Four patterns give the base spans (email, ip, card, phone). The field labels the tokens that hold a digit or an @; all
other tokens are clamped to "none" and only serve as context. Its potentials are: a linear model of each token's shape
and neighbours; a potential between tokens that follow each other; and a potential between distant tokens that repeat
each other or are similar: the same letters and digits in another form, or the same seven digits at the end or the start
(skip edges). Each repetition is linked to the one before it only, so that the edges grow in proportion to the tokens.
Loopy belief propagation over the document's graph carries a label from where it is certain to where the same number or
address stands in another form, and makes the labels of one string consistent.

The weights are learned piecewise in numpy, from the labels that the patterns give on a bounded sample (`sample_rows`
documents that hold a digit or an @): the unary model by gradient descent, both edge potentials as log ratios of label
pairs counted on the edges. Tokens whose marginal for one kind is at least `least` give further spans; base ones stay.

Defined cases: a null text is empty and has no spans; very long texts, tokens and runs of digits are labelled whole, in time
proportional to them; of kinds with equal marginals
the first one listed counts; repeated rows give equal rows; with no sample nothing is added; an
empty table gives none; further columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.llm.arrow import bounded_sample, map_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
MARKED = re.compile(r"[0-9@]")
SAMPLE_ROWS = 3000
BITS = 14
NONE = len(KINDS)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """What the pattern finds from left to right, in time proportional to the text."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            pos = m.end()
        at = text.find("@", at + 1 if not m else m.end())
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), sorted."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start():
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and _luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


_EDGE = " \t\r\n\"'`.,;:!?<>[]{}"


def _tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or an @, without the punctuation around them."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if not MARKED.search(text, a, b):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _shape(s: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}" if len(m[0]) < 5 else "9+", s)
    return re.sub(r"[^\W\d_]+", "a", out)


def _features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    rows = []
    for a, b in spans:
        s = text[a:b]
        left, right = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
        digits = sum("0" <= c <= "9" for c in s)
        near = re.sub(r"[0-9]", "9", text[max(0, a - 3) : a].replace("\n", " ")), re.sub(r"[0-9]", "9", text[b : b + 3].replace("\n", " "))
        names = (
            "b", f"s{_shape(s)}", f"d{min(digits, 20)}", f"l{_shape(left[-1].lower()) if left else '^'}",
            f"r{_shape(right[0].lower()) if right else '$'}", f"p{near[0]}", f"n{near[1]}", f"@{'@' in s}{s.count('.')}", f"t{len(s) - digits > digits}",
        )
        rows.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in names])
    return np.array(rows, np.int64).reshape(len(spans), 9)


def _edges(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours, and pairs of a token and the last one before it that repeats it or is like it: the same letters
    and digits whatever stands between them, the same last or first seven digits."""
    chain, skip, last = [], [], {}
    for k, (a, b) in enumerate(spans):
        if k and a - spans[k - 1][1] <= 3:
            chain.append((k - 1, k))
        s = text[a:b].lower()
        d = re.sub(r"[^0-9]", "", s)
        keys = {s, "=" + re.sub(r"[\W_]", "", s)}
        if len(d) >= 7 and "@" not in s:
            keys |= {f"#{d[-7:]}", f"^{d[:7]}"}
        found = {last[key] for key in keys if len(key) >= 4 and key in last}
        skip += [(j, k) for j in sorted(found)]
        last.update(dict.fromkeys(keys, k))
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def _labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.full(len(spans), NONE)
    ordered = sorted((s, e, k) for k, s, e in base)
    at = 0
    for n, (a, b) in enumerate(spans):
        while at < len(ordered) and ordered[at][1] <= a:
            at += 1
        for s, e, k in ordered[at : at + 2]:
            if s < b and e > a:
                y[n] = k
                break
    return y


class SkipChainField:
    def __init__(self):
        n = NONE + 1
        self.weights = np.zeros((1 << BITS, n))
        self.weights[:, NONE] = 1.0
        self.chain = np.zeros((n, n))
        self.skip = np.zeros((n, n))

    def fit(self, texts: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 5) -> SkipChainField:
        n = NONE + 1
        pairs = np.full((2, n, n), 0.5)
        feats, ys = [], []
        for t in texts:
            spans = _tokens(t)
            if not spans:
                continue
            y = _labels(spans, base_spans(t))
            feats.append(_features(t, spans))
            ys.append(y)
            for k, e in enumerate(_edges(t, spans)):
                np.add.at(pairs[k], (y[e[:, 0]], y[e[:, 1]]), 1.0)
        if not feats:
            return self
        x, y = np.concatenate(feats), np.concatenate(ys)
        self.weights[:] = 0
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                p = self.weights[x[part]].sum(axis=1)
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                step = -rate / (1 + epoch) * p / 16
                np.add.at(self.weights, x[part].ravel(), np.repeat(step, x.shape[1], axis=0))
        for k, into in enumerate((self.chain, self.skip)):
            p = pairs[k] / pairs[k].sum()
            into[:] = np.clip(np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))), -4, 4)
        # repeats of one string have one kind: the skip potential rewards it at least this much
        self.skip[:] = (self.skip + self.skip.T) / 2
        kinds = np.arange(NONE)
        self.skip[kinds, kinds] = np.maximum(self.skip[kinds, kinds], 3.0)
        return self

    def marginals(self, text: str, spans: list[tuple[int, int]], rounds: int = 12) -> np.ndarray:
        """By loopy sum-product message passing over chain and skip edges, damped, in log space."""
        unary = self.weights[_features(text, spans)].sum(axis=1)
        chain, skip = _edges(text, spans)
        one = np.concatenate([chain, skip])
        belief = unary
        if len(one):
            pots = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
            src, dst = np.concatenate([one[:, 0], one[:, 1]]), np.concatenate([one[:, 1], one[:, 0]])
            pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(one)) + len(one), np.arange(len(one))])
            msg = np.zeros((len(src), NONE + 1))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, dst, msg)
                out = (belief[src] - msg[back])[:, :, None] + pots
                top = out.max(axis=1)
                out = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
                out -= out.max(axis=1, keepdims=True)
                if np.abs(out - msg).max() < 1e-3:
                    msg = out
                    break
                msg = 0.5 * msg + 0.5 * out
            belief = unary.copy()
            np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> SkipChainField:
    told = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    return SkipChainField().fit([t for (t,) in bounded_sample(told, sample_rows, seed).select("text").toLocalIterator()])


def all_spans(text: str, field: SkipChainField, least: float = 0.9) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    spans = _tokens(text) if "@" in text or DIGIT.search(text) else []
    if not spans:
        return base, base
    free = _labels(spans, base) == NONE
    if not free.any():
        return base, base
    p = field.marginals(text, spans)
    best = p[:, :NONE].argmax(axis=1)
    sure = free & (p[np.arange(len(p)), best] >= least)
    more: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(sure):
        (a, b), kind = spans[k], int(best[k])
        if more and more[-1][0] == kind and kind >= 2 and a - more[-1][2] <= 2 and not text[more[-1][2] : a].strip(" -.()"):
            more[-1] = (kind, more[-1][1], b)
        else:
            more.append((kind, a, b))
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]


def find(docs: DataFrame, field: SkipChainField, least: float = 0.9) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base counts by kind, base_spans, spans."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        f = held.value

        def one(text: str | None) -> tuple:
            base, every = all_spans(text or "", f, least)
            n = [0] * len(KINDS)
            for k, _, _ in base:
                n[k] += 1
            return *n, _joined(base), _joined(every)

        return one

    return map_texts(docs, ["doc_id"], FIELDS, make)


def digest(found: DataFrame) -> DataFrame:
    n = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ",")))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", n.cast("long").alias("n_spans"))
