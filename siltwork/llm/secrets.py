"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Three patterns give the base spans. A fourth kind, `markov`, comes from two character Markov models of order 2: one of
random strings, one of ordinary identifiers and words. A run of 16 or more key characters outside the base spans is a
secret if the log-likelihood ratio of the two models, per character, is above a threshold set on samples held out.

The models learn from labelled samples: secrets that the patterns find in a bounded sample of documents and strings
drawn at random from the usual alphabets (positive), words of that sample, long words, identifiers joined from words, and
rules and repeats of few characters (negative). Whether a run holds digits does not matter. `sample_rows` documents at most, with the smallest hashes, are read for it.

Defined cases: a null text is empty; empty texts have no spans; very long texts are scanned whole, in time proportional
to them; spans that start at one place are ordered by kind; repeated rows give equal rows; an empty table gives none,
and the models then learn from the drawn strings alone; further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.llm.arrow import bounded_sample, map_texts, once_per_batch, replace_text

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: maximal runs; shorter ones would be dropped anyhow
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SAMPLE_ROWS = 4000
#: words that names in programs are made of; ordinary identifiers are joined from these and from words of the sample
NAMES = (
    "get set put add remove delete update insert create make build find load save read write open close start stop run call send receive parse format "
    "check test validate convert copy move merge split join sort filter map reduce count sum max min average total first last next previous current old new "
    "user account customer order item product price amount value number index key name title label text string list array table row column field record "
    "file path folder directory image video audio page document paragraph sentence word token model layer weight bias batch size length width height depth "
    "time date day month year hour minute second start end begin range interval timeout retry limit offset buffer cache queue stack tree node edge graph "
    "config option setting parameter argument default version release build debug info warning error message log trace report summary result status state "
    "server client request response header body session connection socket host port address network message event handler listener callback thread process "
    "http https www com org net edu html htm php css img src ref example home about contact login search site web link url uri api rest json xml "
    "international national public private local global internal external temporary permanent maximum minimum quick brown fox house garden water music"
).split()
#: long words of the four languages
LONG_WORDS = (
    "characteristically counterrevolutionary disproportionately electromagnetically incomprehensibility internationalization interdisciplinary misunderstanding "
    "notwithstanding oversimplification psychophysiological responsibilities straightforwardness telecommunications uncharacteristically unconstitutional "
    "arbeitsunfaehigkeitsbescheinigung aufenthaltsgenehmigung bezirksschornsteinfegermeister durchschnittsgeschwindigkeit freundschaftsbeziehungen "
    "gesellschaftsordnung krankenversicherung lebensversicherungsgesellschaft rechtsschutzversicherung schifffahrtskapitaen verantwortungsbewusstsein wissenschaftler "
    "administrativement constitutionnellement convenablement disproportionnellement extraordinairement gouvernementalement industrialisation intergouvernemental "
    "professionnellement respectueusement responsabilisation successivement administrativamente caracteristicamente constitucionalidad desafortunadamente "
    "electrocardiograma extraordinariamente internacionalizacion interdisciplinariedad otorrinolaringologo particularmente responsabilidades sustancialmente"
).split()
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the three patterns find, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, 0, np.int64)
for _k, _c in enumerate(_ALPHABET, 1):
    _CODE[ord(_c)] = _k
_N = len(_ALPHABET) + 1


def _codes(s: str) -> np.ndarray:
    c = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
    return np.concatenate([[0, 0], c])


class MarkovPair:
    """Log-likelihood ratios, per context of two characters and next character, of random against ordinary strings."""

    def __init__(self, random: list[str], ordinary: list[str], smooth: float = 0.2):
        self.ratio = self._log(random, smooth) - self._log(ordinary, smooth)
        self.threshold = 0.0

    @staticmethod
    def _log(samples: list[str], smooth: float) -> np.ndarray:
        n = np.zeros((_N, _N, _N))
        for s in samples:
            c = _codes(s)
            np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1.0)
        lower = n.sum(axis=0) + 1.0  # order 1 backs order 2 up
        lower /= lower.sum(axis=1, keepdims=True)
        n += smooth * _N * lower[None]
        return np.log(n / n.sum(axis=2, keepdims=True))

    def score(self, s: str) -> float:
        c = _codes(s)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())

    def calibrate(self, random: list[str], ordinary: list[str]) -> None:
        """Put the threshold above nearly all ordinary strings, and not below the middle between both kinds."""
        r, o = np.array([self.score(s) for s in random]), np.array([self.score(s) for s in ordinary])
        if len(r) and len(o):
            self.threshold = float(max(np.quantile(o, 0.9995) + 0.05, (np.quantile(r, 0.02) + np.quantile(o, 0.999)) / 2))


def drawn_strings(n: int, seed: int = 11) -> list[str]:
    """Random strings of the usual key alphabets and lengths."""
    rng = np.random.default_rng(seed)
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    b64 = _ALPHABET[:62]
    return ["".join(rng.choice(list((hexes, upper, b64, b64)[k % 4]), int(rng.integers(16, 48)))) for k in range(n)]


def rules_and_repeats() -> list[str]:
    """Lines drawn with signs, borders of tables, and one or two letters over and over."""
    signs, letters = "+/_=-", _ALPHABET[:52]
    units = [*signs, *letters, *(a + b for a in signs for b in signs if a != b), *(a + b for a in letters[:26] for b in letters[:26] if a != b)]
    out = [(u * 48)[:n] for u in units for n in (16, 17, 24, 40)]
    out += [("+" + c * w) * k + "+" for c in "-=" for w in range(2, 20) for k in range(1, 9)]
    return [s for s in out if len(s) >= 16]


def numbers_and_rows(n: int, seed: int = 11) -> list[str]:
    """Numbers, dates and times, runs of the alphabet and of a keyboard's rows: no keys, however rare their letters are."""
    rng = np.random.default_rng(seed)
    digits = "0123456789"
    rows = ["abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm", "qwertzuiopasdfghjklyxcvbnm", "azertyuiopqsdfghjklmwxcvbn"]
    out = []
    for k in range(n):
        size = int(rng.integers(16, 40))
        kind = k % 8
        if kind == 0:
            s = "".join(rng.choice(list(digits), size))
        elif kind == 1:
            s = (digits[int(rng.integers(10)) :] + digits * 5)[:size]
        elif kind == 2:
            s = "0" * int(rng.integers(4, 16)) + "".join(rng.choice(list(digits), size))
        elif kind in (3, 4):
            sign = "-_/"[int(rng.integers(3))]
            fields = [str(rng.integers(1970, 2040)), *(f"{rng.integers(1, 60):02d}" for _ in range(int(rng.integers(4, 7))))]
            s = sign.join(fields) if kind == 3 else "".join(fields)
        elif kind == 5:
            s = "-".join("".join(rng.choice(list(digits), int(rng.integers(2, 5)))) for _ in range(int(rng.integers(5, 9))))
        else:
            row = rows[int(rng.integers(4))]
            s = (row[int(rng.integers(20)) :] + row * 2)[:size]
            s = s.upper() if kind == 6 else s
        if len(s) >= 16:
            out.append(s)
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> MarkovPair:
    """Models from at most sample_rows documents; whole texts of the sample are read, one after the other."""
    texts = bounded_sample(docs.select("doc_id", "text"), sample_rows, seed).filter("text is not null").select("text")
    found: set[str] = set()
    plain: set[str] = set()
    for (text,) in texts.toLocalIterator():
        spans = base_spans(text)
        for start, kind, end in spans:
            value = text[start:end]
            found.add(ASSIGN.match(value)[2] if kind == 0 else value)
        plain.update(re.findall(r"[A-Za-z]{2,}", text, re.A))
    secrets = [x for s in sorted(found) if (x := "".join(c for c in s if c in _ALPHABET)) and len(x) >= 16]
    words, half = sorted(plain), [*NAMES, *LONG_WORDS]
    while words and len(half) < len(words):
        half += [*NAMES, *LONG_WORDS]
    words += half
    rng = np.random.default_rng(seed)
    made = []
    for k in range(32_000):
        parts = [words[j] for j in rng.integers(0, len(words), int(rng.integers(2, 5)))]
        style = k % 8
        s = "_".join(parts).lower() if style == 0 else "".join(p.capitalize() for p in parts) if style == 1 else "-".join(parts)
        s = "_".join(parts).upper() if style == 3 else "/".join(parts).lower() + str(int(rng.integers(0, 100))) if style == 4 else s
        if style >= 5:
            first = parts[0].lower() if style == 5 else parts[0].upper() if style == 6 else parts[0].capitalize()
            s = first + "".join(p.lower() if style == 7 else p.capitalize() for p in parts[1:])
        made.append(s)
    ordinary = [*words, *made, *rules_and_repeats(), *numbers_and_rows(8000, seed)]
    random = [*drawn_strings(6000, seed), *secrets]
    model = MarkovPair(random[::2], ordinary[::2])
    model.calibrate([s for s in random[1::2]], [s for s in ordinary[1::2] if len(s) >= 16])
    return model


def all_spans(text: str, model: MarkovPair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those with what the models add, each sorted by start, then kind."""
    base = base_spans(text)
    taken: list[list[int]] = []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    more, k = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        if model.score(m[0]) > model.threshold:
            more.append((a, 3, b))
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]


def scan(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def one(text: str | None) -> tuple:
            base, every = all_spans(text or "", m)
            n = [0] * len(KINDS)
            for _, k, _ in every:
                n[k] += 1
            return *n, _joined(base), _joined(every)

        return one

    return map_texts(docs, ["doc_id"], FIELDS, make)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_markov")


def redact_text(text: str, model: MarkovPair) -> str:
    spans, out, at = all_spans(text, model)[1], [], 0
    for a, k, b in spans:
        if k == 0 and (m := ASSIGN.match(text, a, b)):
            a = m.start(2)  # the name of what was assigned may stay
        if b <= at:
            continue
        out += [text[at : max(a, at)], MASK] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """docs with each secret replaced by a mark; rows and columns stay, n_chars follows changed texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return replace_text(docs, once_per_batch(lambda t: None if t is None else redact_text(t, held.value))(F.col("text")))
