"""Ranked lexical search over a two-level quantised index.

The index has a row per document: the places of its terms in the vocabulary of the queries, and for each term a byte, its
impact rounded up to the next multiple of a quantum (first level), and the exact count (second level, with the document's
length). Bytes don't depend on queries. Times the terms' weights and the quantum, their sum bounds a document's score from
above; one quantum less for each term bounds it from below. A task goes over the index in batches: the kth best lower bound
or exact score of an item so far is a score that k documents reach, and every document whose upper bound reaches it is
scored again in exact integers from the second level. Each task gives its k best documents of an item, and the best of
those are the result.

Items are read in parts of at most PART_TERMS terms by a hash of their text, so that what a task holds of them is bounded
(one item's own terms are always held together); each part goes once over the texts. Documents are counted (N), and so are
their terms (L) and the documents of each term (df), over all documents, by Spark. The index is written, first with counts,
then with bytes, as impacts need N and L. A task's k best documents of each item are all that is shuffled.

Defined cases: null texts and texts without a term are no documents; rows that repeat a doc_id are documents of their own
and rank beside one another; items that repeat an item_id, and null item_ids, are items of their own; items without a term,
or whose terms no document holds, give no rows; equal scores go by doc_id, null ones last, then by the document's length;
texts are read whole, in pieces cut between terms; terms are compared as bytes, so that any text will do; an empty table on
either side gives no rows; columns beyond doc_id, text and item_id are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltwork.llm.arrow import slices
from siltwork.session import cut_lineage, free

#: term occurrences of the items of a part
PART_TERMS = 1 << 18
#: what a byte stands for, so that 255 of them reach the largest impact, below a million
QUANTUM = -(-1_000_000 // 255)
#: documents of a batch, items bounded at once, and bytes of text cut into terms at once
BATCH, ITEMS, PIECE = 2048, 256, 1 << 20
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z; every other ASCII sign that is no letter or digit to a space
_FOLD = bytes(c if c >= 0x80 or c in _LETTERS else 0x20 for c in range(256)).translate(bytes.maketrans(_LETTERS[10:36], _LETTERS[36:]))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # to the next sign that is in no term
            while end < len(text) and _FOLD[text[end]] != 0x20:
                end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def dampers(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents by their lengths; in whole numbers of any size."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([75 + 25 * int(v) * docs // total for v in n], np.int64)
    return 75 + 25 * n.astype(np.int64) * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (terms), term (places in the vocabulary, ascending), tf; a row per document."""
    fields = [docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields)
    kinds = to_arrow_schema(schema)
    ours = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = ours.value
        for b in slices(batches):
            ids, lengths, found, times = [], [], [], []
            for k, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                n, own = 0, Counter()
                for words in terms(text or b""):
                    n += len(words)
                    own.update([w for w in words if w in places])
                if n:
                    by_place = sorted((places[w], c) for w, c in own.items())
                    ids.append(k)
                    lengths.append(n)
                    found.append([p for p, _ in by_place])
                    times.append([c for _, c in by_place])
            made = [b.column(0).take(pa.array(ids, pa.int64())).cast(kinds.field(0).type), *(pa.array(x, kinds.field(k).type) for k, x in ((1, lengths), (2, found), (3, times)))]
            yield pa.RecordBatch.from_arrays(made, schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_impacts(index: DataFrame, docs: int, total: int) -> DataFrame:
    """The first level: impacts rounded up to bytes (held as they come, 1 to 255)."""
    big = F.lit(25 * docs).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)") / F.lit(max(1, total)).cast("decimal(19,0)")
    m = F.lit(75) + F.floor(big).cast("long")
    exact = F.transform("tf", lambda tf: F.floor(F.lit(1_000_000_000).cast("long") * tf / (1000 * tf + 12 * F.col("m"))))
    # a quotient in doubles may be off by one; a unit more keeps the byte an upper bound
    return index.withColumn("m", m).withColumn("byte", F.transform(exact, lambda x: F.least(F.floor((x + QUANTUM) / QUANTUM), F.lit(255).cast("long")).cast("short")))


class Postings:
    """A batch of documents, as flat arrays of (document, term, ...) sorted by term."""

    def __init__(self, b: pa.RecordBatch):
        col = lambda c: b.column(b.schema.get_field_index(c))
        lists = col("term")
        sizes = np.asarray(pa.compute.list_value_length(lists), np.int64)
        self.docs = b.num_rows
        self.n = np.asarray(col("n"), np.int64)
        self.m = np.asarray(col("m"), np.int64)
        doc, term = np.repeat(np.arange(self.docs), sizes), np.asarray(lists.flatten(), np.int64)
        order = np.argsort(term, kind="stable")
        self.doc, self.term = doc[order], term[order]
        self.tf = np.asarray(col("tf").flatten(), np.int64)[order]
        self.byte = np.asarray(col("byte").flatten(), np.int64)[order]
        self.starts = np.flatnonzero(np.r_[True, self.term[1:] != self.term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.ends = np.r_[self.starts[1:], len(term)].astype(np.int64)


def best_of(batches: Iterator[Postings], holders: list[tuple[np.ndarray, np.ndarray]], items: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, item, document of the batch, score) of documents that may be among the k best of an item; holders: for each
    term the items that hold it and its weight times its occurrences there."""
    reached = np.full((items, k), 0, np.int64)  # the k best scores so far, ascending; none is 0 or less
    for at, p in enumerate(batches):
        for low in range(0, items, ITEMS):
            high = min(items, low + ITEMS)
            upper, below = np.zeros((high - low, p.docs), np.int64), np.zeros((high - low, p.docs), np.int64)
            touched = []
            for a, z in zip(p.starts, p.ends):
                who, gain = holders[p.term[a]]
                f, t = np.searchsorted(who, (low, high))
                if f < t:
                    touched.append((a, z, f, t))
                    where = np.ix_(who[f:t] - low, p.doc[a:z])
                    upper[where] += gain[f:t, None] * p.byte[a:z][None, :]
                    below[where] += gain[f:t, None]
            lower = (upper - below) * QUANTUM
            upper *= QUANTUM
            known = np.sort(np.concatenate([reached[low:high], np.partition(lower, p.docs - k, axis=1)[:, p.docs - k :] if p.docs > k else lower], axis=1), axis=1)
            kth = known[:, -k]
            maybe = (upper >= np.maximum(kth, 1)[:, None]) & (upper > 0)
            exact = np.zeros(maybe.shape, np.int64)
            for a, z, f, t in touched:  # the second level, for those that stay
                who, gain = holders[p.term[a]]
                r, c = np.nonzero(maybe[np.ix_(who[f:t] - low, p.doc[a:z])])
                if len(r):
                    each = impact(p.tf[a:z][c], p.m[p.doc[a:z][c]])
                    exact[who[f + r] - low, p.doc[a + c]] += gain[f + r] * each
            reached[low:high] = np.sort(np.concatenate([reached[low:high], np.partition(exact, p.docs - k, axis=1)[:, p.docs - k :] if p.docs > k else exact], axis=1), axis=1)[:, -k:]
            i, d = np.nonzero(maybe & (exact >= np.maximum(reached[low:high, 0], 1)[:, None]))
            if len(i):
                yield at, i + low, d, exact[i, d]


def part_of(items: DataFrame, parts: int, part: int) -> list[tuple]:
    """(item_id, text) of one part, in an order of their own."""
    own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).select("item_id", "text")
    return sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (str(r[0]), r[1]))


def rank(docs: DataFrame, items: DataFrame, k: int = 20, part_terms: int = PART_TERMS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score."""
    items = items.filter(F.col("text").isNotNull())
    # a term has a sign and what parts it from the next at least, so that this is a bound
    bound = items.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    parts = max(1, -(-int(bound) // part_terms))
    found = [_rank_part(docs, part_of(items, parts, p), items, k) for p in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _rank_part(docs: DataFrame, items: list[tuple], schema_of: DataFrame, k: int) -> DataFrame:
    held = [Counter(w for words in terms(text.encode("utf-8", "surrogatepass")) for w in words) for _, text in items]
    vocabulary = {w: n for n, w in enumerate(sorted(set().union(*held)))}
    first = cut_lineage(counted(docs, vocabulary))
    seen = first.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    n_docs, total = seen["docs"], seen["total"] or 1
    df = {r["t"]: r["df"] for r in first.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    index = cut_lineage(with_impacts(first.filter(F.size("term") > 0), n_docs, total))
    free(first)

    names = sorted(vocabulary, key=vocabulary.get)
    at: list[list[tuple[int, int]]] = [[] for _ in names]
    for i, own in enumerate(held):
        for w, times in own.items():
            at[vocabulary[w]].append((i, times))
    holders = [
        (np.array([i for i, _ in who], np.int64), np.array([times * weight(n_docs, df.get(t, 0)) for _, times in who], np.int64)) for t, who in enumerate(at)
    ]
    ours = docs.sparkSession.sparkContext.broadcast(holders)
    n_items = len(items)
    schema = T.StructType([T.StructField("item", T.IntegerType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("score", T.LongType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        last: dict[int, pa.RecordBatch] = {}

        def read() -> Iterator[Postings]:
            for n, b in enumerate(slices(batches, BATCH)):
                last.clear()
                last[n] = b
                yield Postings(b)

        for n, i, d, s in best_of(read(), ours.value, n_items, k):
            b = last[n]
            ids = b.column(b.schema.get_field_index("doc_id")).take(pa.array(d)).cast(kinds.field(1).type)
            lengths = b.column(b.schema.get_field_index("n")).take(pa.array(d)).cast(pa.int64())
            more = pa.table([pa.array(i, pa.int32()), ids, lengths, pa.array(s, pa.int64())], schema=kinds)
            kept = more if kept is None else pa.concat_tables([kept, more])
            if kept.num_rows > 64 * k * max(1, n_items):
                kept = _cut(kept, k)
        if kept is not None:
            yield from _cut(kept, k).combine_chunks().to_batches()

    best = index.mapInArrow(run, schema)
    w = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "n")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    names_of = docs.sparkSession.createDataFrame([(n, r[0]) for n, r in enumerate(items)], T.StructType([T.StructField("item", T.IntegerType()), schema_of.schema["item_id"]]))
    return ranked.join(names_of, "item").select("item_id", "rank", "doc_id", "score")


def _cut(kept: pa.Table, k: int) -> pa.Table:
    """The k best rows of each item; rows that tie with the kth stay, for Spark to order."""
    item, score = kept.column("item").to_numpy(), kept.column("score").to_numpy()
    order = np.lexsort((~score, item))
    item, score = item[order], score[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    sizes = np.diff(np.r_[first, len(item)])
    kth = np.repeat(score[np.minimum(first + k, first + sizes) - 1], sizes)
    return kept.take(pa.array(order[score >= kth]))
