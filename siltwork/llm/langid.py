"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Subwords are the runs of 3, 4 and 5 UTF-8 bytes of the lower-cased text that lie within a word and the spaces next to
it; everything but letters counts as space. Each is hashed to a row of an embedding table; a text is the mean of its
rows, and a linear layer with softmax gives the languages. Both layers are trained by stochastic gradient descent in
numpy on a bounded sample of labelled texts: about `sample_rows`, shared evenly between all labels, one each at least;
each counts as a whole, and once more as a few words in a row, so that short texts are met. On a part held back, a
temperature makes the scores probabilities, and the score below which a prediction is marked as rejected is set so that
accepted ones are right to `accuracy`.

As mean and layer are both linear, predicting sums one small vector of scores per subword.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; labels that are null are not
learned from; with nothing to learn from all texts are `und`; of languages with equal scores the first by name is
predicted; very long texts count whole, in pieces; rows are handled one by one, so that repeats agree; an empty table
gives no rows; columns beyond doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.llm.arrow import map_texts, share_of
from siltwork.llm.text import mixed

BITS = 15
SIZES = (3, 4, 5)
UND = "und"
SAMPLE_ROWS = 3000
_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_U = np.uint64
_STEP = tuple(_U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(max(SIZES)))


def pieces(text: str, size: int = 1 << 18):
    """The text as bytes of words between single characters of space, in bounded pieces cut at spaces."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_ONLY)
    at = 0
    while at < len(raw):
        to = len(raw) if len(raw) - at <= size else raw.rfind(b" ", at + 1, at + size)
        to = to if to > at else min(len(raw), at + size)
        yield b" " + raw[at:to] + b" "
        at = to


def subwords(piece: bytes) -> np.ndarray:
    """Row numbers of the embedding table, one for each subword."""
    a = np.frombuffer(piece, np.uint8)
    spaces = np.concatenate([[0], np.cumsum(a == 32)])
    wide = a.astype(_U)
    out = []
    total = np.zeros(len(a), _U)
    done = 0
    for n in SIZES:
        m = len(a) - n + 1
        if m <= 0:
            break
        for j in range(done, n):
            total[: len(a) - j] += wide[j:] * _STEP[j]
        done = n
        inner = spaces[n - 1 : n - 1 + m] - spaces[1 : m + 1]
        keep = (inner == 0) & (a[:m] != 32) | (inner == 0) & (a[n - 1 :] != 32)
        out.append((mixed(total[:m][keep] + _U(n)) >> _U(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class LanguageModel:
    def __init__(self, languages: list[str], dim: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.rng = languages, rng
        self.rows = rng.normal(0, 0.3, (1 << BITS, dim)).astype(np.float32)
        self.out = np.zeros((dim, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature, self.least = 1.0, 0.0
        self.table: np.ndarray | None = None

    def fit(self, samples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 1.0, accuracy: float = 0.995, batch: int = 16) -> LanguageModel:
        """samples: language, and the distinct subwords of each text with their shares. A tenth is held back for calibration."""
        order = self.rng.permutation(len(samples))
        held = order[: len(order) // 10]
        train = order[len(order) // 10 :] if len(order) >= 20 else order
        index = {x: k for k, x in enumerate(self.languages)}
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for part in np.array_split(self.rng.permutation(train), max(1, len(train) // batch)):
                y = np.array([index[samples[k][0]] for k in part])
                own = np.unique(np.concatenate([samples[k][1] for k in part]))
                shares = np.zeros((len(part), len(own)), np.float32)
                for row, k in enumerate(part):
                    shares[row, np.searchsorted(own, samples[k][1])] = samples[k][2]
                rows = self.rows[own]
                mean = shares @ rows
                logits = mean @ self.out + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                grad = (p @ self.out.T).astype(np.float32)
                self.out -= step / len(y) * 8 * (mean.T @ p)
                self.bias -= step / len(y) * p.sum(axis=0)
                self.rows[own] = rows - step * (shares.T @ grad)
        self.table = (self.rows @ self.out).astype(np.float32)
        z, y = [], []
        for k in held:
            z.append(samples[k][2] @ self.table[samples[k][1]] + self.bias)
            y.append(index[samples[k][0]])
        if z:
            self._calibrate(np.array(z), np.array(y), accuracy)
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray, accuracy: float) -> None:
        def logp(t: float) -> np.ndarray:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

        self.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -logp(t)[np.arange(len(y)), y].mean()))
        p = np.exp(logp(self.temperature))
        order = np.argsort(-p.max(axis=1))
        right = (p.argmax(axis=1) == y)[order]
        ok = np.flatnonzero(np.cumsum(right) / np.arange(1, len(y) + 1) >= accuracy)
        self.least = float(p.max(axis=1)[order][ok[-1]]) if len(ok) else 1.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for piece in pieces(text):
            ids = subwords(piece)
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k])), bool(p[k] < self.least)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subwords of a text and their shares."""
    counts = np.zeros(1 << BITS, np.int64)
    for piece in pieces(text):
        counts += np.bincount(subwords(piece), minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids, (counts[ids] / max(1, counts.sum())).astype(np.float32)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> LanguageModel:
    """From documents (text, lang) that are not held out; about sample_rows of them, those with the least hashes."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel([])
    quota = max(1, sample_rows // len(counts))
    shares = known.sparkSession.createDataFrame([(r["lang"], (quota + 6 * quota**0.5 + 10) / r["count"]) for r in counts], "lang string, most double")
    drawn = known.join(F.broadcast(shares) if len(counts) < 100_000 else shares, "lang").withColumn("draw", share_of(seed, "doc_id", "text")).filter("draw < most")
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "text"))).filter(F.col("rank") <= quota)
    rng = np.random.default_rng(seed)
    samples = []
    for r in ranked.orderBy("draw", "lang", "doc_id", "text").select("text", "lang").toLocalIterator():
        words = r["text"].split()
        a, n = int(rng.integers(max(1, len(words) - 3))), int(rng.integers(3, 25))
        for text in (r["text"], " ".join(words[a : a + n])):
            ids, share = bag(text)
            if len(ids):
                samples.append((r["lang"], ids, share))
    return LanguageModel(sorted({x for x, _, _ in samples}), seed=seed).fit(samples) if samples else LanguageModel([])


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, ["doc_id"], FIELDS, lambda: held.value.predict)


def digest(identified: DataFrame) -> DataFrame:
    return identified.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
