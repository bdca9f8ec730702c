"""Profiles of text corpora: figures per document, categories, terms, weights, topics, label checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import texts as X
from siltwork.functions import values as V
from siltwork.operators.profile import median, quantile_values
from siltwork.operators.registry import RID
from siltwork.session import cut_lineage, free

TOO_SHORT = 5
#: with so many sums of classes by term or fewer, they are broadcast
FEW_SUMS = 1 << 19


def doc_metrics(df: DataFrame) -> DataFrame:
    """df with words, chars, sentences, language, mojibake, html."""
    t = F.col("text")
    return df.withColumns({
        "words": X.word_count(t), "chars": F.length(F.coalesce(t, F.lit(""))).cast("long"), "sentences": X.sentence_count(t),
        "language": X.language(t), "mojibake": X.has_mojibake(t), "html": X.has_html(t),
    })


def corpus_overview(df: DataFrame) -> DataFrame:
    m = df.select(X.word_count(F.col("text")).alias("words"), X.sentence_count(F.col("text")).alias("sentences"), X.flesch(F.col("text")).alias("flesch"), X.language(F.col("text")).alias("language"))
    m = cut_lineage(m.select("words", "sentences", F.when(F.col("language") == "en", F.col("flesch")).alias("flesch")))
    medians = {c: F.lit(q.get(c, [None])[0]).cast("double") for q in [quantile_values(m, ["words", "flesch"], [0.5])] for c in ("words", "flesch")}
    facts = m.agg(
        F.count("*").alias("documents"), F.min("words").alias("words_min"), V.r4(medians["words"]).alias("words_median"), F.max("words").alias("words_max"),
        F.sum("words").alias("words_total"), F.sum("sentences").alias("sentences"), V.r4(medians["flesch"]).alias("flesch_median"),
    )
    vocabulary = df.select(F.explode(F.transform(X.words(F.col("text")), F.lower)).alias("w")).groupBy("w").count().agg(F.count("*").alias("vocabulary"))
    return facts.join(F.broadcast(vocabulary)).withColumn("type_token_ratio", V.r4(F.col("vocabulary") / F.nullif(F.col("words_total"), F.lit(0))))


def language_mix(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    n = df.groupBy(X.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))
    return n.withColumn("share", V.r4(F.col("n") / F.sum("n").over(W.partitionBy())))


def categories(df: DataFrame, main_language: str | None = None) -> DataFrame:
    """df with one main problem per document, the first that applies."""
    m = doc_metrics(df)
    if main_language is None:
        row = language_mix(df).filter("language <> 'unknown'").orderBy(F.desc("n"), "language").first()
        main_language = row["language"] if row else "unknown"
    limit = max(1000.0, 10 * (median(df, X.word_count(F.col("text"))) or 0.0))
    other = (F.col("language") != main_language) & (F.col("language") != "unknown") if main_language != "unknown" else F.lit(False)
    rule = (
        F.when(F.col("words") == 0, "empty").when(F.col("mojibake"), "encoding_damage").when(F.col("html"), "html_markup")
        .when(F.col("words") < TOO_SHORT, "too_short").when(other, "other_language").when(F.col("words") > limit, "very_long").otherwise("ok")
    )
    return m.withColumn("category", rule)


def media_category(df: DataFrame, media: str) -> DataFrame:
    """The same for tables of image, audio or video metrics."""
    def low(c: str, v) -> Column:
        return F.coalesce(F.col(c) < v, F.lit(False))

    bad = F.coalesce(F.col("corrupt"), F.lit(False))
    if media == "image":
        least = median(df.filter(~bad), F.col("blur"))
        blurry = F.coalesce(F.col("blur") < 0.25 * least, F.lit(False)) if least is not None else F.lit(False)
        rule = (
            F.when(bad, "corrupt").when(F.least("width", "height") < 32, "tiny").when(low("brightness", 25), "too_dark").when(F.coalesce(F.col("brightness") > 235, F.lit(False)), "too_bright")
            .when(low("contrast", 4), "near_blank").when(blurry, "blurry").otherwise("ok")
        )
        return df.withColumn("category", rule)
    if media == "audio":
        rule = (
            F.when(bad, "corrupt").when(F.coalesce(F.col("silence_ratio") >= 0.97, F.lit(False)), "silent").when(low("duration", 0.3), "too_short")
            .when(F.coalesce(F.col("clipping") > 0.001, F.lit(False)), "clipped").when(low("snr_db", 10), "noisy").when(low("rms_db", -40), "very_quiet").otherwise("ok")
        )
    else:
        rule = (
            F.when(bad, "corrupt").when(low("duration", 1), "too_short").when(F.coalesce(F.col("black_ratio") >= 0.9, F.lit(False)), "black")
            .when(low("motion", 1), "frozen").when(low("brightness", 40), "very_dark").otherwise("ok")
        )
    return df.withColumn("category", rule)


def pii_counts(df: DataFrame) -> DataFrame:
    """Documents and occurrences by kind of private data."""
    hits = df.select(X.pii(F.col("text")).alias("p")).select(F.explode("p").alias("kind", "hits"))
    return hits.groupBy("kind").agg(F.count("*").alias("documents"), F.sum(F.size("hits")).alias("occurrences"))


def _tokens(c: Column) -> Column:
    return F.transform(X.words(c), F.lower)


def document_terms(df: DataFrame, k: int = 15, bigrams: bool = False, stop: frozenset[str] = frozenset()) -> DataFrame:
    """The k words, or pairs of words, that occur in most documents."""
    w = _tokens(F.col("text"))
    w = F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*stop)) if stop else w
    if bigrams:
        w = X.bound(w, lambda v: F.when(F.size(v) > 1, F.transform(F.slice(v, F.lit(1), F.size(v) - 1), lambda x, i: F.concat_ws(" ", x, F.element_at(v, i + 2)))))
    terms = df.select(F.explode(F.array_distinct(w)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "term").limit(k)


def distinctive_words(df: DataFrame, label: str = "class", k: int = 6) -> DataFrame:
    """Per class, words in many of its documents and in few others."""
    from pyspark.sql import Window as W

    seen = df.select(F.col(label).alias("label"), F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term"))
    cells = seen.groupBy("label", "term").agg(F.count("*").alias("c"))
    totals = cells.groupBy("term").agg(F.sum("c").alias("df"))
    members = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("members"))
    n = df.agg(F.count("*").alias("n"))
    told = cells.join(totals, "term").join(members, "label").join(F.broadcast(n)).filter((F.col("c") >= 2) & (F.col("c") >= 0.1 * F.col("members")))
    told = told.withColumn("score", (F.col("c") / F.col("members")) / ((F.col("df") + 1) / F.col("n")))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "term"))
    return told.withColumn("rank", rank).filter(F.col("rank") <= k).select("label", "term", V.r4(F.col("score")).alias("score"), "rank")


def tfidf(df: DataFrame, key: str = RID, vocabulary: int = 2000) -> DataFrame:
    """(key, term, weight): 1 + ln tf, times ln((1 + n) / (1 + df)) + 1, of unit length per document."""
    return _weights(df, key, vocabulary)[0]


def _weights(df: DataFrame, key: str, vocabulary: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Those weights, and the table of counts that they are worked out from."""
    n = df.count()
    # words are cut and counted once, for frequencies, weights and lengths
    tf = cut_lineage(df.select(F.col(key), F.explode(_tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    freq = tf.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= 2) & (F.col("df") <= (0.5 * n if n >= 10 else n)))
    freq = freq.orderBy(F.desc("df"), "term").limit(vocabulary)
    w = (1 + F.log("tf")) * (F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1)
    weights = tf.join(F.broadcast(freq), "term").select(key, "term", w.alias("w"))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight")), tf


def label_check(df: DataFrame, label: str = "class", key: str = RID, margin: float = 0.05) -> DataFrame:
    """Per document, its class, the class with the nearest centroid when it is left out itself, and the margin.

    Similarity to a class: the document's weights times the class sums, less its own part, over the length of that sum;
    lengths without a document follow from the length with it, so that no vector is built again for each document.

    A document doesn't meet every class. Its similarity to its own class, and to one that holds its foremost term most, is
    a bound to be reached. Terms go in the order of the most that they can add for any class; once those left can't reach
    the bound together, a class with none of the terms before them can't be the nearest. Classes with one are met on these
    terms first, and in full only where that and what is left reach the bound.
    """
    from pyspark.sql import Window as W

    weights, counts = _weights(df, key)
    w = cut_lineage(weights.join(df.select(key, F.col(label).alias("own")), key).select(key, "own", "term", "weight"))
    free(counts)
    sums = w.groupBy("own", "term").agg(F.sum("weight").alias("s")).withColumnRenamed("own", "label")
    length = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("len2"))
    # of a class without one of its documents, no more than the sum is left, and the length less one
    unit = cut_lineage(sums.join(length, "label").withColumn("most", F.col("s") / F.sqrt(F.greatest("len2", F.lit(1e-12)))))
    # weights of few sums meet them where they are; those of many classes are dealt by class and term
    totals = F.broadcast(unit) if unit.count() <= FEW_SUMS else unit
    most = unit.groupBy("term").agg(F.max("most").alias("most"), F.max_by("label", F.struct("most", "label")).alias("holder"))
    held = cut_lineage(w.join(F.broadcast(most), "term").withColumn("gain", F.col("weight") * F.col("most")))

    def cosines(pairs: DataFrame) -> DataFrame:
        """pairs (key, label) -> key, own, label, cosine, of classes that share a term with the document."""
        met = pairs.join(w, key).join(totals.drop("most"), ["label", "term"]).groupBy(key, "own", "label").agg(F.sum(F.col("weight") * F.col("s")).alias("dot"), F.max("len2").alias("len2"))
        mine = F.col("own").eqNullSafe(F.col("label"))
        left2 = F.greatest(F.when(mine, F.col("len2") - 2 * F.col("dot") + 1).otherwise(F.col("len2")), F.lit(0.0))
        cosine = F.when(left2 > 1e-12, F.when(mine, F.col("dot") - 1).otherwise(F.col("dot")) / F.sqrt(left2)).otherwise(F.lit(0.0))
        return met.select(key, "own", "label", cosine.alias("cosine"))

    first = held.groupBy(key).agg(F.max_by("holder", F.struct("gain", "term")).alias("label"))
    own = w.select(key, F.col("own").alias("label")).distinct()
    begun = cut_lineage(cosines(first.union(own).filter("label IS NOT NULL").distinct()))
    reach = begun.groupBy(key).agg(F.max("cosine").alias("bound"))
    order = W.partitionBy(key).orderBy(F.asc("gain"), "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = held.join(reach, key, "left").withColumn("upto", F.sum("gain").over(order))  # what this term and those after it can add
    ahead = cut_lineage(placed.filter(F.col("upto") >= F.coalesce("bound", F.lit(0.0)) - 1e-9).select(key, "own", "term", "weight", "bound", (F.col("upto") - F.col("gain")).alias("left")))
    # classes met on the foremost terms; all others can add `left` at most
    partly = ahead.join(totals.select("label", "term", "most"), "term").groupBy(key, "label").agg(F.sum(F.col("weight") * F.col("most")).alias("dot"), F.first("bound").alias("bound"))
    rest = ahead.groupBy(key).agg(F.min("left").alias("left"))
    open_ = partly.join(rest, key).filter(F.col("dot") + F.col("left") >= F.coalesce("bound", F.lit(0.0)) - 1e-9).select(key, "label")
    scored = begun.union(cosines(open_.join(begun, [key, "label"], "left_anti")))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("cosine"), "label"))
    mine = F.col("own").eqNullSafe(F.col("label"))
    best = scored.withColumn("rank", rank).groupBy(key, "own").agg(
        F.min_by("label", "rank").alias("nearest"), F.max("cosine").alias("best"), F.max(F.when(mine, F.col("cosine"))).alias("own_cosine")
    )
    gap = F.col("best") - F.coalesce("own_cosine", F.lit(0.0))
    # a row per document is all that stays on disk
    out = cut_lineage(best.select(key, F.col("own").alias("label"), "nearest", V.r4(gap).alias("margin"), ((F.col("own") != F.col("nearest")) & (gap >= margin)).alias("suspected")))
    free(w, unit, held, begun, ahead)
    return out


def nonnegative(gram: np.ndarray, cross: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Rows w >= 0 of least squares, from gram = h h' and cross = v h': each coordinate in turn goes to where its gradient
    is 0, until nothing moves."""
    w = np.zeros(cross.shape)
    scale = np.maximum(np.diag(gram), 1e-12)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(gram)):
            new = np.maximum(0.0, w[:, j] + (cross[:, j] - w @ gram[:, j]) / scale[j])
            moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if moved < 1e-9:
            break
    return w


class SparseRows:
    """Documents as rows of (place of a word, weight), in Spark; their factors are worked out where the rows are."""

    def __init__(self, weights: DataFrame, key: str, places: DataFrame):
        row = F.collect_list(F.struct("place", "weight"))
        held = weights.join(F.broadcast(places), "term").groupBy(key).agg(row.alias("r"))
        self.rows = cut_lineage(held.select(key, F.transform("r", lambda x: x["place"]).alias("p"), F.transform("r", lambda x: x["weight"]).alias("v")))
        self.key = key

    @staticmethod
    def _solved(b: pd.DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = b["p"].map(len).to_numpy()
        doc, place = np.repeat(np.arange(len(b)), sizes), np.concatenate(b["p"].to_numpy())
        value = np.concatenate(b["v"].to_numpy())
        cross = np.zeros((len(b), len(h)))
        np.add.at(cross, doc, h.T[place] * value[:, None])
        return nonnegative(h @ h.T, cross), cross, doc, place, value

    def sums(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """w'w, w'v and the squared residual for the best w of each document; one pass, of which a task gives its sums."""

        def run(batches):
            k, t = h.shape
            ww, wv, left = np.zeros((k, k)), np.zeros((k, t)), 0.0
            for b in batches:
                if not len(b):
                    continue
                w, cross, doc, place, value = SparseRows._solved(b, h)
                ww += w.T @ w
                for j in range(k):
                    wv[j] += np.bincount(place, weights=w[doc, j] * value, minlength=t)
                left += float((value * value).sum() - 2 * (w * cross).sum() + (w @ (h @ h.T) * w).sum())
            flat = np.concatenate([ww.ravel(), wv.ravel(), [left]])
            yield pd.DataFrame({"at": np.arange(len(flat)), "x": flat})

        got = self.rows.mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(h.shape[0] * (h.shape[0] + h.shape[1]) + 1)
        for r in got:
            flat[r["at"]] = r["x"]
        k = h.shape[0]
        return flat[: k * k].reshape(k, k), flat[k * k : -1].reshape(k, -1), float(flat[-1])

    def topic(self, h: np.ndarray) -> DataFrame:
        """(key, topic, share): the topic with the largest factor of each document, and its part of all of them."""
        kind = self.rows.schema[self.key].dataType.simpleString()
        key = self.key

        def run(batches):
            for b in batches:
                if len(b):
                    w = SparseRows._solved(b, h)[0]
                    total = w.sum(axis=1)
                    yield pd.DataFrame({key: b[key], "topic": w.argmax(axis=1).astype("int32"), "share": w.max(axis=1) / np.maximum(total, 1e-12)})

        return self.rows.mapInPandas(run, f"`{key}` {kind}, topic int, share double")


def factorise(rows: SparseRows, k: int, terms: int, rounds: int = 60, seed: int = 0, enough: float = 1e-5) -> tuple[np.ndarray, float]:
    """(h, squared residual): h of unit rows, so that the rows are near non-negative sums of those of h.

    A round is one pass over the rows. With h given, the best factors of a document depend on that document alone and are
    worked out anew, so that none are kept; what comes back are two small matrices, from which h follows."""
    h = np.random.default_rng(seed).random((k, terms)) + 0.01
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    last = float("inf")
    for _ in range(rounds):
        ww, wv, left = rows.sums(h)
        if last - left <= enough * left:
            break
        last = left
        new = nonnegative(ww + 1e-12 * np.eye(k), wv.T).T
        length = np.linalg.norm(new, axis=1, keepdims=True)
        h = np.where(length > 0, new / np.maximum(length, 1e-12), h)
    return h, left


def topics(df: DataFrame, k: int | None = None, labels: int = 0, rounds: int = 60, seed: int = 0, key: str = RID, words: int = 6) -> list[dict]:
    """Topics by non-negative factorisation of the weights of words over all documents; a document belongs to the topic
    with its largest factor. Documents without a weighted word have none."""
    k = k or min(6, max(2, labels or df.count() // 25))
    weights = cut_lineage(tfidf(df, key))
    terms = sorted(r["term"] for r in weights.select("term").distinct().collect())  # 2,000 at most
    if not terms:
        return []
    places = df.sparkSession.createDataFrame([(t, n) for n, t in enumerate(terms)], "term string, place int")
    rows = SparseRows(weights, key, places)
    h, _ = factorise(rows, k, len(terms), rounds, seed)
    own = {r["topic"]: r["n"] for r in rows.topic(h).groupBy("topic").agg(F.count("*").alias("n")).collect()}
    free(weights, rows.rows)
    total = max(1, sum(own.values()))
    return [{"topic": j, "words": [terms[i] for i in np.argsort(-h[j], kind="stable")[:words]], "share": round(own.get(j, 0) / total, 4)} for j in range(k)]


def entities(df: DataFrame) -> DataFrame:
    """Documents with links, mentions, tags and amounts of money."""
    return df.agg(*[F.count_if(c > 0).alias(name) for name, c in X.entity_counts(F.col("text")).items()])


def transcript_facts(clips: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """clips (path, text, words, language) -> clips with speech, without, languages, and clips whose label isn't spoken."""
    out = clips.agg(F.count("*").alias("clips"), F.count_if(F.col("words") > 0).alias("with_speech"), F.count_if(F.coalesce(F.col("words"), F.lit(0)) == 0).alias("without"), F.countDistinct(F.when(F.col("words") > 0, F.col("language"))).alias("languages"))
    if labels is None:
        return out
    said = clips.join(labels.select("path", "class"), "path").filter("words > 0")
    wrong = said.agg(F.count_if(~F.array_contains(_tokens(F.col("text")), F.lower("class"))).alias("mismatches"))
    return out.join(F.broadcast(wrong))


def scene_rows(videos: DataFrame, most_seconds: float = 120.0) -> DataFrame:
    """videos (path, duration, scenes: JSON list of cuts) -> path, n, start, end of each scene that isn't empty."""
    end = F.least(F.col("duration"), F.lit(most_seconds))
    cuts = F.filter(F.coalesce(F.from_json("scenes", "array<double>"), F.array().cast("array<double>")), lambda x: (x > 0) & (x < end))
    edges = F.concat(F.array(F.lit(0.0)), F.array_sort(F.array_distinct(cuts)), F.array(end))
    spans = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("start"), F.element_at(edges, i + 1).alias("end")))
    spans = F.filter(spans, lambda s: s["end"] > s["start"])
    return videos.select("path", F.posexplode(spans).alias("n", "s")).select("path", (F.col("n") + 1).alias("n"), "s.start", "s.end")
