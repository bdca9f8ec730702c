"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words of any item. Training words are streamed through it; after each word it knows
the length of the longest run of item words that ends there. A run of `window` words or more marks the last words as
hit; an item shorter than the window is one window as a whole. Spans of hit words are removed, and documents of which
more than a limit is hit are dropped.

The automaton lives in each Python worker. Its size follows the test items, not the corpus, and is bounded by parts of
at most `part_words` item words: larger benchmarks are split into parts, one pass over the documents each. Passes are
branches of a union and hand on what they hit only, so that no task holds more than one automaton, however many parts
there are. What all parts hit is put together by text before the limit is applied and anything is cut, and texts that
were cut are scanned for all parts again, so that results do not depend on the number of parts.

Defined cases: null or wordless texts have no words and are never contaminated; null or wordless items match nothing; a
null item_id counts as an item whose id is the empty string; repeated documents each get their own row; an empty
benchmark leaves all documents clean; columns of other names are carried along or ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.llm.arrow import map_texts, once_per_batch, replace_text
from siltwork.llm.text import fold, word_spans, words
from siltwork.session import cut_lineage

WINDOW = 10
PART_WORDS = 250_000


class SuffixAutomaton:
    """Of lists of words, with what a match of `window` words, or of a whole shorter item, means."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        for i, (_, ws) in enumerate(items):
            last = 0
            for w in ws:
                last = self._extend(last, w)
                ends.append((last, i))
        # items by state: those whose words end at the state itself, handed on to all suffixes
        own: list[set[int]] = [set() for _ in self.next]
        for state, i in ends:
            own[state].add(i)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.link[v] > 0:
                own[self.link[v]] |= own[v]
        #: for states whose runs can be as long as the window: the items that hold the last `window` words
        self.holders: list[frozenset[int] | None] = [None] * len(self.next)
        #: for states: the lengths and numbers of short items that end in it
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        at_end: dict[int, list[tuple[int, int]]] = {}
        for i, (_, ws) in enumerate(items):
            if 0 < len(ws) < window:
                v = 0
                for w in ws:
                    v = self.next[v][w]
                at_end.setdefault(v, []).append((len(ws), i))
        for v in reversed(order):
            up = self.link[v]
            self.short[v] = tuple(at_end.get(v, ())) + (self.short[up] if up > 0 else ())
            if self.length[v] >= window:
                self.holders[v] = self.holders[up] if self.length[up] >= window else frozenset(own[v])

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def scan(self, ws: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans [from, to) of hit words, merged where they touch, and the numbers of the items that occur."""
        nxt, link, length, short, holders, window = self.next, self.link, self.length, self.short, self.holders, self.window
        spans: list[list[int]] = []
        found: set[int] = set()
        root = nxt[0]
        v = size = 0
        for at, w in enumerate(ws, 1):
            to = nxt[v].get(w)
            if to is not None:
                v, size = to, size + 1
            elif v:
                v = link[v]
                while v and w not in nxt[v]:
                    v = link[v]
                to = nxt[v].get(w)
                size = length[v] + 1 if to is not None else 0
                v = to or 0
            else:
                continue
            if size >= window:
                found |= holders[v]
                reach = window
            else:
                reach = 0
            for n, i in short[v]:
                if n <= size:
                    found.add(i)
                    reach = max(reach, n)
            if reach:
                start = at - reach
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = at
                else:
                    spans.append([start, at])
        return spans, found


_built: dict[int, tuple[SuffixAutomaton, list[str]]] = {}


def _automaton(part, window: int) -> tuple[SuffixAutomaton, list[str]]:
    """Built once in each Python worker."""
    if part.bid not in _built:
        items = [(i, words(t)) for i, t in part.value]
        _built.clear()
        _built[part.bid] = (SuffixAutomaton(items, window), [i for i, _ in items])
    return _built[part.bid]


class _Part:
    def __init__(self, bid: int, held):
        self.bid, self.held = bid, held

    @property
    def value(self):
        return self.held.value


def item_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> list[_Part]:
    """The items as broadcast lists of at most about part_words words each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).filter("t is not null")
    n = items.select(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-n // (4 * part_words)))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    out = []
    for k in range(parts):
        rows = [(r.i, r.t) for r in dealt.filter(F.col("part") == k).select("i", "t").toLocalIterator()]
        held = spark.sparkContext.broadcast(rows)
        out.append(_Part(held._jbroadcast.id(), held))
    return out


SPANS = T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))
MARKS = [T.StructField("n_words", T.LongType()), SPANS, T.StructField("items", T.ArrayType(T.StringType()))]


#: columns that tell texts apart
KEYS = ["__k1", "__k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with KEYS: marks depend on the text only, and copies share them."""
    return docs.withColumns(dict(zip(KEYS, (F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))))


def _scanned(docs: DataFrame, keep: list[str], part: _Part, window: int) -> DataFrame:
    def make():
        auto, ids = _automaton(part, window)

        def one(text: str | None) -> tuple:
            ws = words(text)
            spans, found = auto.scan(ws)
            return len(ws), spans, [ids[k] for k in found]

        return one

    return map_texts(docs, keep, MARKS, make)


def _hits(keyed: DataFrame, parts: list[_Part], window: int) -> DataFrame:
    """keyed (KEYS, text) -> KEYS, spans (not merged), items for each text that one of the parts hits."""
    found = (_scanned(keyed, KEYS, part, window).filter(F.size("spans") > 0).withColumn("part", F.lit(k)) for k, part in enumerate(parts))
    once = reduce(DataFrame.union, found).dropDuplicates([*KEYS, "part"])
    return once.groupBy(*KEYS).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, spans of hit words, ids of the items that occur."""
    first, *rest = item_parts(benchmark, part_words)
    docs = docs.select("doc_id", "text")
    if not rest:
        return _scanned(docs, ["doc_id"], first, window)
    keyed = _keyed(docs)
    more = _hits(keyed, rest, window).select(*KEYS, F.col("spans").alias("more_spans"), F.col("items").alias("more_items"))
    both = _scanned(keyed, ["doc_id", *KEYS], first, window).join(more, KEYS, "left")
    spans, items = (F.concat(c, F.coalesce(f"more_{c}", F.array())) for c in ("spans", "items"))
    return both.select("doc_id", "n_words", _merged(F.array_sort(spans)).alias("spans"), items.alias("items"))


def _merged(spans: Column) -> Column:
    """Sorted spans, joined where they touch."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(done) > 0) & (last[1] >= s[0]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS.dataType), add)


def _cut(text: str, spans: list[list[int]], s: np.ndarray, e: np.ndarray) -> str:
    """The text without the words of the spans; words stand at the byte offsets [s, e)."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(raw[at : s[a]])
        at = int(e[b - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def _covered(spans: list[list[int]], n_words: int, max_coverage: float) -> bool:
    return sum(b - a for a, b in spans) > max_coverage * n_words


def strip_text(text: str | None, auto: SuffixAutomaton, max_coverage: float) -> str | None:
    """The text without its hit spans, until none is left; null if more than max_coverage of its words is hit."""
    first = True
    while text is not None:
        folded = fold(text)
        spans, _ = auto.scan(folded.split())
        if not spans:
            return text
        s, e = word_spans(folded)
        if first and _covered(spans, len(s), max_coverage):
            return None
        first = False
        text = _cut(text, spans, s, e)
    return text


def _without_spans(max_coverage: float | None):
    """A column function that cuts merged spans, as a list of ends, out of texts; null where they cover more than max_coverage."""

    def run(texts: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for text, ends in zip(texts, held):
            spans = np.asarray(ends).reshape(-1, 2).tolist()
            s, e = word_spans(fold(text))
            over = max_coverage is not None and _covered(spans, len(s), max_coverage)
            out.append(None if over else _cut(text, spans, s, e))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()


def _strip_in_parts(docs: DataFrame, parts: list[_Part], window: int, max_coverage: float) -> DataFrame:
    """What strip_text gives with one automaton of all parts: a round for each time a text is cut, of those texts only."""
    done, rest, limit = [], docs, max_coverage
    while True:
        keyed = _keyed(rest)
        spans = F.flatten(_merged(F.array_sort("spans"))).alias("__spans")
        hits = cut_lineage(_hits(keyed, parts, window).select(*KEYS, spans))
        done.append(keyed.join(hits, KEYS, "left_anti").select(rest.columns))
        if hits.isEmpty():
            return reduce(DataFrame.union, done)
        hit = keyed.join(hits, KEYS).select(*rest.columns, "__spans")
        rest, limit = cut_lineage(replace_text(hit, _without_spans(limit)(F.col("text"), F.col("__spans"))).drop("__spans")), None


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, part_words: int = PART_WORDS) -> DataFrame:
    """docs without the passages they share with test items, and without documents made of them for the most part.

    Columns stay as they are, but that n_chars, where there is one, follows a changed text. Null texts stay.
    """
    parts = item_parts(benchmark, part_words)
    if len(parts) > 1:
        return _strip_in_parts(docs, parts, window, max_coverage)

    def clean(text: str | None, part=parts[0]) -> str | None:
        return strip_text(text, _automaton(part, window)[0], max_coverage)

    return replace_text(docs, once_per_batch(clean)(F.col("text")))


def digest(marked: DataFrame) -> DataFrame:
    """One row per document with counts in place of spans."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    items = F.array_sort(F.array_distinct("items"))
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """What mark and digest must give, by comparing every place with every window."""
    out = {}
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for k, (name, it) in enumerate(items):
            iw = words(it)
            n = min(window, len(iw))
            if not n:
                continue
            wins = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)}
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    found.add("" if name is None else str(name))
        ids = ",".join(sorted(found))
        out[i] = (len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out
