"""Quality classifier by co-training of a text view and a metadata view.

The text view sees what is written: shares of runs of three character classes (letters by case, digits, each sign as
itself) and of words, hashed into columns, and figures of repetition. The metadata view sees the record: language,
source, n_chars and the layout of the page (lines, their mean and greatest length, blank ones), cut into bins at
quantiles; names are hashed into columns. No figure belongs to both.

Both views start from the labelled documents. In each round each view scores all unlabelled documents and hands those it
is surest of, good and bad in the proportion of the labels, `exchanged` in all, to the other one. In the end both are
calibrated on labelled documents held back (Platt scaling), their calibrated log-odds are added up with weights fitted
there, and the documents whose probability of bad quality is above a threshold are rejected. The threshold is set so that
at most `false_rejects` of the good documents held back go, and lies between 0.5 and 0.9.

Fitted on a bounded sample of labelled documents, `labelled_rows` with the least hashes; pseudo-labels are searched for
among all documents, and all are scored. The views of the sample and of the pseudo-labelled documents are written, and an
executor's task fits both models from them; to the driver come weights, ids and labels, never views or texts.

Defined cases: a null text counts as empty; null source, language or n_chars are values of their own; documents labelled
more than once count by the mean of their labels; null labels and labels of unknown documents are left out; without
labels of both kinds nothing is rejected and all scores are 0.5; documents that a view is equally sure of are taken by
the hash of their id; very long texts are read whole; repeated rows agree; an empty table gives no rows; extra columns
are carried along.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltwork.llm.arrow import share_of, slices
from siltwork.llm.text import fold, mixed, word_hashes
from siltwork.session import cut_lineage, free

LABELLED_ROWS = 6000
EXCHANGED = 600
ROUNDS = 2
BINS = 12
#: columns that runs of classes, words and names are hashed into
RUNS, WORDS, NAMES = 512, 384, 128

# classes of bytes: letters by case, digits, everything else as itself; bytes beyond ASCII count as small letters
_CLASS = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b == 32 else 5 if b == 10 else 0 for b in range(256)], np.int64)
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SIGNS] = np.arange(6, 6 + len(_SIGNS))
_N = 6 + len(_SIGNS)
_RUN = (mixed(np.arange(_N**3, dtype=np.uint64)) % np.uint64(RUNS)).astype(np.int64)
_STEPS = 8
TEXT_COLUMNS = RUNS + WORDS + 2 * _STEPS


def text_view(text: str) -> np.ndarray:
    """One row of the text view."""
    c = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    h = word_hashes(fold(text))
    n = len(h)
    seen = np.bincount(_RUN[c[:-2] * (_N * _N) + c[1:-1] * _N + c[2:]], minlength=RUNS) if len(c) > 2 else np.zeros(RUNS)
    words = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    figures = np.zeros((2, _STEPS))
    again = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    variety = len(np.unique(h)) / n if n else 0.0
    figures[0, min(_STEPS - 1, int(again * _STEPS))] = figures[1, min(_STEPS - 1, int(variety * _STEPS))] = 1
    return np.concatenate([np.sqrt(seen / max(1, len(c))), np.sqrt(words / max(1, n)), figures.ravel()]).astype(np.float32)


def record_figures(text: str, n_chars: int | None) -> list[float]:
    """Figures of the metadata view: what the record says of its length, and the layout."""
    lengths = [len(x) for x in text.split("\n")]
    return [np.log1p(max(0, len(text) if n_chars is None else n_chars)), np.log1p(len(lengths)), np.log1p(sum(lengths) / len(lengths)), np.log1p(max(lengths)), float(np.mean([x == 0 for x in lengths]))]


def record_names(lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(2 * NAMES, np.float32)
    for k, x in enumerate((lang, source)):
        out[k * NAMES + zlib.crc32(repr(x).encode("utf-8", "surrogatepass")) % NAMES] = 1
    return out


class Logistic:
    """L2-regularised logistic regression by Newton's method on a dense matrix."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty
        self.w = np.zeros(1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 12) -> Logistic:
        s = np.ones(len(y)) if weight is None else weight
        w = np.zeros(x.shape[1] + 1)
        ridge = np.full(len(w), self.penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            g, h = ridge * w, np.diag(ridge)
            for r in range(0, len(x), 512):  # in parts, so that few rows are held in full precision
                part = np.hstack([x[r : r + 512], np.ones((len(x[r : r + 512]), 1))]).astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
                g += part.T @ (s[r : r + 512] * (p - y[r : r + 512]))
                h += (part * (s[r : r + 512] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ part
            d = np.linalg.solve(h, g)
            w -= d * min(1.0, 4.0 / max(1e-9, float(np.abs(x @ d[:-1] + d[-1]).max())))
            if np.abs(d).max() < 1e-4:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


class CoTrained:
    """Two views of a document; bad quality is class 1. Rows: (text view, figures, names)."""

    def __init__(self):
        self.ready = False
        self.threshold = 0.5
        self.accuracy: dict[str, float] = {}

    def _meta(self, figures: list[float], names: np.ndarray) -> np.ndarray:
        row = np.zeros((len(self.cuts), BINS), np.float32)
        for k, cut in enumerate(self.cuts):
            row[k, np.searchsorted(cut, figures[k], side="right")] = 1
        return np.concatenate([row.ravel(), names])

    def start(self, labelled: list[tuple], bad: list[float], seed: int = 9, fit: bool = True) -> CoTrained:
        """First fit, on three quarters of the labelled documents; the others are held back."""
        y = np.array(bad)
        if len(set(bad)) < 2:
            return self
        figures = np.array([r[1] for r in labelled])
        self.cuts = [np.unique(np.quantile(figures[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(figures.shape[1])]
        views = self._views(labelled)
        order = np.random.default_rng(seed).permutation(len(y))
        held, train = order[: max(1, len(y) // 4)], order[max(1, len(y) // 4) :]
        if len(set(y[train])) < 2 or len(set(y[held])) < 2:
            held = train = order
        self.held = ([v[held] for v in views], y[held])
        self.known = [(v[train], y[train], np.ones(len(train))) for v in views]
        self.bad_share = float(y[train].mean())
        self.ready = True
        if fit:
            self._fit()
        return self

    def _views(self, rows: list[tuple]) -> list[np.ndarray]:
        return [np.array([r[0] for r in rows]), np.array([self._meta(r[1], r[2]) for r in rows])]

    def _fit(self) -> None:
        self.models = [Logistic(p).fit(*k) for p, k in zip((0.3, 0.3), self.known)]

    def exchange(self, rows: list[tuple], told: list[dict[int, float]], fit: bool = True) -> None:
        """Learn from pseudo-labels: told[v] maps places in rows to the label that view v gives for the other view."""
        views = self._views(rows) if rows else []
        for v in (0, 1):
            ks = sorted(told[1 - v])
            if ks:
                x, y, w = self.known[v]
                self.known[v] = (np.concatenate([x, views[v][ks]]), np.concatenate([y, [told[1 - v][k] for k in ks]]), np.concatenate([w, np.full(len(ks), 0.5)]))
        if fit:
            self._fit()

    def finish(self, false_rejects: float = 0.005) -> CoTrained:
        """Calibrate both views and their sum on what was held back."""
        views, y = self.held
        z = np.stack([self.models[v].logit(views[v]) for v in (0, 1)], axis=1)
        self.platt = [Logistic(0.01).fit(z[:, [v]], y) for v in (0, 1)]
        both = np.stack([self.platt[v].logit(z[:, [v]]) for v in (0, 1)], axis=1)
        self.joint = Logistic(0.01).fit(both, y)
        p = 1 / (1 + np.exp(-np.clip(self.joint.logit(both), -30, 30)))
        self.threshold = float(np.clip(np.quantile(p[y == 0], 1 - false_rejects), 0.5, 0.9))
        self.accuracy = {"text": float(((z[:, 0] > 0) == y).mean()), "metadata": float(((z[:, 1] > 0) == y).mean()), "joint": float(((p > self.threshold) == y).mean())}
        return self

    def logits(self, row: tuple) -> tuple[float, float]:
        return float(self.models[0].logit(row[0])), float(self.models[1].logit(self._meta(row[1], row[2])))

    def score(self, row: tuple) -> tuple[float, float, float]:
        """Probability of bad quality by the text view, the metadata view and both."""
        if not self.ready:
            return 0.5, 0.5, 0.5
        z = self.logits(row)
        both = np.array([self.platt[v].logit(np.array([z[v]])) for v in (0, 1)])
        p = 1 / (1 + np.exp(-np.clip(np.append(both, self.joint.logit(both)), -30, 30)))
        return float(p[0]), float(p[1]), float(p[2])


def _rows(batch: pa.RecordBatch, first: int):
    """A row of both views for each document of a batch that has text, lang, source and n_chars from column `first` on."""
    for t, lang, source, n in zip(*(batch.column(first + k).to_pylist() for k in range(4))):
        t = t or ""
        yield text_view(t), record_figures(t, n), record_names(lang, source)


_RAW = T.StructType([T.StructField("id", T.LongType()), T.StructField("view", T.BinaryType()), T.StructField("figures", T.ArrayType(T.DoubleType())), T.StructField("names", T.BinaryType())])


def _read(docs: DataFrame) -> DataFrame:
    """doc_id as a long, and what both views read; n_chars is null where there is no such column."""
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang", "source", n.alias("n_chars"))


def _viewed(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The views of the documents that told (id, turn, bad, by_text, by_meta) names, written with what it says of them."""
    kinds = to_arrow_schema(_RAW)

    def run(batches):
        for b in slices(batches):
            rows = [(x.tobytes(), [float(f) for f in y], z.tobytes()) for x, y, z in _rows(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kinds.field(1 + k).type) for k in range(3))], schema=kinds)

    few = docs.join(F.broadcast(told.select("id")), "id")
    return cut_lineage(few.mapInArrow(run, _RAW).join(F.broadcast(told), "id"))


_TOLD = "id long, turn int, bad double, by_text double, by_meta double"


def _learned(rows: pd.DataFrame, seed: int, finish: bool) -> CoTrained:
    """The model from the rows of all turns so far: labelled documents (turn 0) and pseudo-labelled ones; of several rows
    with one id in a turn, one."""
    rows = rows.sort_values(["turn", "id", "view", "names"]).drop_duplicates(["turn", "id"])
    read = lambda own: [(np.frombuffer(v, np.float32), list(f), np.frombuffer(n, np.float32)) for v, f, n in zip(own["view"], own["figures"], own["names"])]
    turns = sorted(set(rows["turn"]) - {0})
    first = rows[rows["turn"] == 0]
    model = CoTrained().start(read(first), first["bad"].tolist(), seed, fit=not turns)
    for k in turns if model.ready else []:
        own = rows[rows["turn"] == k]
        told = [{n: y for n, y in enumerate(own[c]) if not np.isnan(y)} for c in ("by_text", "by_meta")]
        model.exchange(read(own), told, fit=k == turns[-1])
    if model.ready and finish:
        model.finish()
    for held in ("held", "known"):
        model.__dict__.pop(held, None)
    return model


def _fitted(tables: list[DataFrame], seed: int, finish: bool = False) -> CoTrained:
    """The model, fitted in a task: the rows are bounded by the sample and the pseudo-labels exchanged."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(_learned(rows, seed, finish))]})

    rows = tables[0]
    for more in tables[1:]:
        rows = rows.union(more)
    got = rows.withColumn("together", F.lit(0)).groupBy("together").applyInPandas(run, "model binary").first()
    return pickle.loads(got["model"]) if got else CoTrained()


def train(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, exchanged: int = EXCHANGED, rounds: int = ROUNDS, seed: int = 9, sure: float = 1.5
) -> CoTrained:
    """docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality: 0 is bad)."""
    own = _read(docs).filter("id IS NOT NULL")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") < 0.5).cast("double").alias("bad"))
    none = F.lit(None).cast("double")
    sample = known.orderBy(share_of(seed, "id"), "id").limit(labelled_rows).select("id", F.lit(0).alias("turn"), "bad", none.alias("by_text"), none.alias("by_meta"))
    spark = docs.sparkSession
    tables = [_viewed(own, cut_lineage(sample))]
    model = _fitted(tables, seed)
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f"z{v}", T.DoubleType()) for v in (0, 1))])
    for turn in range(1, rounds + 1 if model.ready else 1):
        held = spark.sparkContext.broadcast(model)

        def run(batches, held=held):
            for b in slices(batches):
                z = [held.value.logits(r) for r in _rows(b, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[v] for x in z], pa.float64()) for v in (0, 1))], schema=to_arrow_schema(schema))

        scored = cut_lineage(own.mapInArrow(run, schema).join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]), own.count())
        few = max(1, round(exchanged * model.bad_share))
        told: dict[int, list] = {}
        for v in (0, 1):
            z = F.col(f"z{v}")
            for label, order, ok, most in ((1.0, z.desc(), z > sure, few), (0.0, z.asc(), z < -sure, max(1, exchanged - few))):
                for r in scored.filter(ok).orderBy(order, share_of(seed, "id"), "id").limit(most).select("id").collect():
                    told.setdefault(r["id"], [None, None])[v] = label
        free(scored)
        held.unpersist()
        if told:
            new = spark.createDataFrame([(i, turn, None, *y) for i, y in sorted(told.items())], _TOLD)
            tables.append(_viewed(own, new))
        model = _fitted(tables, seed, finish=turn == rounds)
    if model.ready and rounds == 0:
        model = _fitted(tables, seed, finish=True)
    free(*tables)
    return model


SCORES = [T.StructField(x, T.DoubleType()) for x in ("text_score", "meta_score", "score")] + [T.StructField("rejected", T.BooleanType())]


def _judged(m: CoTrained, batch: pa.RecordBatch, first: int) -> list[tuple]:
    """Scores and verdict for each row of a batch, see _rows."""
    return [(*p, m.ready and p[2] > m.threshold) for p in map(m.score, _rows(batch, first))]


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs -> doc_id, probabilities of bad quality by view and joint, and whether the document is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], *SCORES])
    kinds = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches):
            rows = _judged(held.value, b, 1)
            made = [pa.array([r[k] for r in rows], kinds.field(1 + k).type) for k in range(len(SCORES))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(kinds.field(0).type), *made], schema=kinds)

    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", "lang", "source", n.alias("n_chars")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs without those the model rejects; columns stay, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches):
        for b in slices(batches):
            keep = pa.array([not r[3] for r in _judged(held.value, b, n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(n)], names=b.schema.names[:n]).filter(keep)

    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    read = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(c).alias(f"__{c}") for c in ("text", "lang", "source")], chars.alias("__n_chars"))
    return read.mapInArrow(run, docs.schema)
