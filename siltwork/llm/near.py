"""Near-duplicate units (documents, paragraphs): candidates by MinHash prefixes, exact Jaccard links, classes.

A unit is a text, or a part of it; its set is that of the hashes of five words in a row. Units with equal sets (128
bits) are copies and stand together as one class from the start, so that groups of copies cost no pairs; classes are
numbered when they are written. The signature of a class is `groups` labels of `deepest` minima each. Classes whose
labels begin alike in one group share a prefix; each is tied to the least class of the prefix, and the connected
components of these ties hold every pair that shares one. Within a component all pairs are compared exactly, in cells of
two blocks of classes, each of bounded size; cells give links counted per class and ties to one member, never lists of
pairs. Components of the linked classes are the groups.

Prefixes start at their longest and are shortened adaptively: the similarities of the links found tell how likely such
links are found with prefixes of that length, so that the links found estimate those missed. While the estimated recall
is below the target, or no link tells of it, prefixes are shortened to the length that the links ask for, and only
components that grow by it are compared again. The shortest length is the one that reaches the target at the threshold
itself. With one length (banding) there is a single round.

Only classes that share a prefix of the shortest length are read a second time, for their sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltwork.operators.graph import components
from siltwork.llm.arrow import slices
from siltwork.llm.text import MinHash, fold, many_set_keys, many_shingles, shingle_set, word_hashes
from siltwork.session import FILE_DOCS, cut_lineage, free

#: shingles in a block; with more than MOST_BLOCKS of that size, blocks grow up to LARGE_BLOCK; classes in a block
SMALL_BLOCK, MOST_BLOCKS, LARGE_BLOCK, BLOCK_CLASSES = 1 << 16, 24, 1 << 20, 1 << 11
#: classes of a block that are compared with another block at once
ROWS = 256
#: bytes of text that are hashed at once, and shingles of small components that are compared in one group of rows
PIECE, BUNDLE = 1 << 17, 1 << 15
_U = np.uint64


def recall_at(similarity, groups: int, depth: int):
    """The chance that two sets of that similarity share a prefix of depth minima in one of the groups."""
    return 1 - (1 - similarity**depth) ** groups


@dataclass(frozen=True)
class Near:
    """groups labels of deepest minima each, shortened to shortest at most; links from a Jaccard similarity of threshold on."""

    groups: int
    deepest: int
    shortest: int
    bytes_each: int  # of a minimum that a label keeps
    width: int = 5
    threshold: float = 0.8
    target: float = 1.0
    seed: int = 1
    split: Callable[[str], list[tuple[int, int]]] | None = None  # parts of a text as [from, to); none: the text is the unit

    def units(self, text: str | None) -> list[tuple[int, str]]:
        if text is None:
            return []
        if self.split is None:
            return [(0, text)]
        return [(k, text[a:b]) for k, (a, b) in enumerate(self.split(text))]

    def prefix(self, group: Column, depth: int) -> Column:
        """One number for the first depth minima of a group's label."""
        at = group * (self.deepest * self.bytes_each) + 1
        return F.xxhash64(group, F.substring(F.col("sig"), at, F.lit(depth * self.bytes_each)))


UNIT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("part", T.IntegerType()),
        T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()),
    ]
)


def as_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.field(k).type) for k in range(len(kinds))], schema=kinds)


def row_key() -> Column:
    """Together with doc_id, tells rows of docs apart by their text."""
    return F.xxhash64("text")


def place() -> Column:
    """Orders units: by id, those without one last, then by place in the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "part", "h")


def _signed(held: list[tuple], near: Near, sign: MinHash) -> pa.RecordBatch:
    """(doc_id, h, part, folded text) of some units as rows of UNIT, all worked out at once."""
    s, starts, which = many_shingles([x[3] for x in held], near.width)
    if not len(which):
        return as_batch([], UNIT)
    k1, k2 = many_set_keys(s, starts)
    n = np.diff(np.append(starts, len(s)))
    # a set so small that one shingle more or less already takes it below the threshold has copies only, and needs no signature
    keyed = n >= near.threshold * (n + 1) - 1e-9
    large = s[np.repeat(keyed, n)]
    sigs = iter(sign.labels(large, np.concatenate([[0], np.cumsum(n[keyed])[:-1]]), near.bytes_each) if len(large) else [])
    chosen = [held[k] for k in which.tolist()]
    kinds = to_arrow_schema(UNIT)
    columns = [
        *(pa.array([x[k] for x in chosen], kinds.field(k).type) for k in range(3)), pa.array(k1), pa.array(k2), pa.array(n.astype(np.int64)),
        pa.array([next(sigs) if x else None for x in keyed.tolist()], kinds.field(6).type),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


def units_of(docs: DataFrame, near: Near) -> DataFrame:
    """docs (doc_id, text) -> a row for each unit with a word: doc_id, h, part, k1, k2, n, sig."""

    def run(batches):
        sign = MinHash(near.groups * near.deepest, near.seed)
        for b in slices(batches):
            held, size = [], 0
            for i, t, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                for part, text in near.units(t):
                    held.append((i, h, part, fold(text)))
                    size += len(held[-1][3])
                    if size >= PIECE:
                        yield _signed(held, near, sign)
                        held, size = [], 0
            if held:
                yield _signed(held, near, sign)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("h")).mapInArrow(run, UNIT)


def _links(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right) whose sets have at least the Jaccard similarity threshold, and that similarity."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(start, len(flat)))
    pos_l, pos_r = np.full(len(sets), -1), np.full(len(sets), -1)
    pos_l[left], pos_r[right] = np.arange(len(left)), np.arange(len(right))
    same = np.zeros((len(left), len(right)), np.int32)
    # frequent shingles as columns of two 0/1 matrices
    often = np.flatnonzero(count > 24)
    for at in range(0, len(often), 1024):
        cols = often[at : at + 1024]
        which = np.repeat(np.arange(len(cols)), count[cols])
        rows = owner[np.concatenate([np.arange(start[c], start[c] + count[c]) for c in cols])]
        a, b = np.zeros((len(left), len(cols)), np.float32), np.zeros((len(right), len(cols)), np.float32)
        k = pos_l[rows] >= 0
        a[pos_l[rows[k]], which[k]] = 1
        k = pos_r[rows] >= 0
        b[pos_r[rows[k]], which[k]] = 1
        for r in range(0, len(left), ROWS):
            same[r : r + ROWS] += np.rint(a[r : r + ROWS] @ b.T).astype(np.int32)
    # rare ones as pairs of places, by distance in the list of owners
    rare = (count > 1) & (count <= 24)
    label = np.repeat(np.where(rare, np.arange(len(count)), -1), count)
    for gap in range(1, 24):
        if gap >= len(label):
            break
        k = np.flatnonzero((label[gap:] == label[:-gap]) & (label[gap:] >= 0))
        if not len(k):
            break
        x, y = owner[k], owner[k + gap]
        for p, q in ((x, y), (y, x)):
            ok = (pos_l[p] >= 0) & (pos_r[q] >= 0)
            if ok.any():
                code = pos_l[p[ok]] * len(right) + pos_r[q[ok]]
                got, n = np.unique(code, return_counts=True)
                same.ravel()[got] += n.astype(np.int32)
    found = []
    for r in range(0, len(left), ROWS):
        part = same[r : r + ROWS]
        i, j = np.nonzero(part >= threshold * (sizes[left[r : r + ROWS]][:, None] + sizes[right][None, :] - part) - 1e-9)
        found.append((i + r, j))
    i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    keep = left[i] != right[j]
    i, j = i[keep], j[keep]
    shared = same[i, j]
    return i, j, shared / (sizes[left[i]] + sizes[right[j]] - shared)


LINKS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("cid", "tie", "links", "others")] + [T.StructField("alike", T.ArrayType(T.LongType()))]
)
#: bins of the similarities of links, from the threshold to 1
ALIKE = 20


def _cell(near: Near):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, block, ids, copies = (pdf[c].to_numpy() for c in ("label", "block", "cid", "copies"))
        order = np.lexsort((ids, block, label))
        label, block, ids, copies = label[order], block[order], ids[order], copies[order]
        # rows that repeat id and text give a class more than once
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (block[1:] != block[:-1]) | (label[1:] != label[:-1])])
        order, label, block, ids, copies = order[new], label[new], block[new], ids[new], copies[new]
        raw, alone = pdf["s"].to_numpy(), pdf["alone"].to_numpy()
        out, alike = [], []
        edges = np.append(np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])), len(label))
        for a, z in zip(edges[:-1], edges[1:]):
            sets = [np.frombuffer(raw[k], _U) for k in order[a:z]]
            found = compare(sets, ids[a:z], copies[a:z], block[a:z], bool(alone[order[a]]), near)
            if found is not None:
                out.append(found[0])
                alike.extend(found[1].tolist())
        made = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pd.DataFrame(dict(zip(LINKS.names, made))).assign(alike=pd.Series(alike, dtype=object))

    return run


def compare(sets: list[np.ndarray], ids: np.ndarray, copies: np.ndarray, blocks: np.ndarray, alone: bool, near: Near) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows cid, tie, links, others, and alike (numbers of links by similarity), for the classes with links among those of
    one or two blocks of a component."""
    one = blocks[0] == blocks[-1]
    if len(sets) < 2 or one and not alone:
        return None
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(blocks == blocks[0])
    right = left if one else np.flatnonzero(blocks == blocks[-1])
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        if n < near.threshold * (sizes.sum() - n) - 1e-9:
            return None
        a, b, alike = np.array([0, 1]), np.array([1, 0]), np.repeat(n / (sizes.sum() - n), 2)
    else:
        i, j, alike = _links(sets, sizes, left, right, near.threshold)
        a, b = left[i], right[j]
        if not one:
            a, b, alike = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([alike, alike])
    links, others = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(others, a, 1)
    bins = np.minimum(((alike - near.threshold + 1e-9) / max(1e-9, 1 - near.threshold) * ALIKE).astype(np.int64), ALIKE - 1)
    seen = np.bincount(a * ALIKE + bins, minlength=len(ids) * ALIKE).reshape(len(ids), ALIKE)
    tie = ids.copy()  # local components by minimum labels
    while len(a):
        new = tie.copy()
        np.minimum.at(new, a, tie[b])
        if (new == tie).all():
            break
        tie = new
    k = others > 0
    return (np.array([ids[k], tie[k], links[k], others[k]], np.int64), seen[k]) if k.any() else None


def _sets_of(docs: DataFrame, near: Near, members: DataFrame) -> DataFrame:
    """members (cid, rep) -> cid, s: the set of each class, from the text that holds its first unit."""
    per_doc = members.groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h")).agg(F.collect_list(F.struct(F.col("rep.part").alias("part"), "cid")).alias("m"))
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), "text", row_key().alias("t_h"))
    held = texts.join(per_doc, texts["t_id"].eqNullSafe(per_doc["doc_id"]) & (texts["t_h"] == per_doc["h"])).select("text", "m")
    row = T.StructType([T.StructField("cid", T.LongType()), T.StructField("s", T.BinaryType())])

    def run(batches):
        for b in slices(batches):
            rows = []
            for t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = dict(near.units(t))
                for x in m:
                    rows.append((x["cid"], shingle_set(word_hashes(fold(parts[x["part"]])), near.width).tobytes()))
                    if len(rows) >= 2048:
                        yield as_batch(rows, row)
                        rows = []
            if rows:
                yield as_batch(rows, row)

    return held.mapInArrow(run, row)


def _ties(classes: DataFrame, near: Near, depth: int) -> DataFrame:
    """(a, b): each class that shares a prefix with a lesser one, and the least of that prefix."""
    placed = classes.filter("sig IS NOT NULL").select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(near.groups - 1))).alias("g"))
    placed = placed.select("cid", near.prefix(F.col("g"), depth).alias("key"))
    shared = placed.groupBy("key").agg(F.min("cid").alias("a"), F.count("*").alias("m")).filter("m > 1").select("key", "a")
    return placed.join(shared, "key").filter("cid <> a").select("a", F.col("cid").alias("b")).distinct()


def _compared(inside: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """inside (cid, label, n, copies), whole components -> rows of LINKS."""
    total = inside.groupBy("label").agg(F.sum("n").alias("all"), F.count("*").alias("m"))
    few, large, wide = F.ceil(F.col("all") / SMALL_BLOCK), F.ceil(F.col("all") / LARGE_BLOCK), F.ceil(F.col("m") / BLOCK_CLASSES)
    total = total.select("label", F.greatest(F.least(few, F.lit(MOST_BLOCKS)), large, wide).cast("int").alias("blocks"))
    members = inside.join(total, "label").select("cid", "copies", "label", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"))
    found = sets.join(members, "cid")
    # a block meets itself once, and each other block once
    cells = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).withColumn("alone", F.col("lo") == F.col("hi"))
    # components of one block are bundled, so that a group of rows is worth its cost
    bundles = max(1, (inside.agg(F.sum("n")).first()[0] or 0) // BUNDLE)
    cells = cells.withColumn("bundle", F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bundles))))
    return cells.groupBy("blocks", "bundle", "lo", "hi").applyInPandas(_cell(near), LINKS)


def expected_recall(links: np.ndarray, near: Near, found_with: int, depth: int) -> float:
    """The share of all links that prefixes of a length find, from those found with another length, counted by similarity.

    Bins count as their lower ends, so that the estimate is on the safe side; without a link nothing is known, and it is 0."""
    low = near.threshold + (1 - near.threshold) / ALIKE * np.arange(ALIKE)
    every = links / recall_at(low, near.groups, found_with)
    return float((every * recall_at(low, near.groups, depth)).sum() / every.sum()) if every.sum() else 0.0


def near_classes(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame, dict]:
    """(units, classes, report): classes (cid, k1, k2, copies, rep, label, links, others) with label the least cid of the
    group, links the number of units of other classes that are linked, others the number of those classes. report: the
    length of prefixes that was reached, links between classes that were found, and the recall estimated from them."""
    docs = docs.select("doc_id", "text")
    docs_n = docs.count()
    units = cut_lineage(units_of(docs, near), docs_n, FILE_DOCS)
    units_n = units.count()
    classes = units.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(place()).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()), units_n)
    ties = cut_lineage(_ties(classes, near, near.shortest), units_n * near.groups)
    members = ties.select(F.col("a").alias("cid")).union(ties.select(F.col("b").alias("cid"))).distinct()
    sets = cut_lineage(_sets_of(docs, near, classes.select("cid", "rep").join(members, "cid")), docs_n, FILE_DOCS)
    most = 2 * ties.count()  # classes in components
    inside = linked = None
    depth, report = near.deepest, {}
    while True:
        own = ties if depth == near.shortest else cut_lineage(_ties(classes, near, depth), most * near.groups)
        label = components(own, most=most * near.groups)
        now = cut_lineage(classes.select("cid", "n", "copies").join(label.withColumnRenamed("id", "cid"), "cid"), most)
        if inside is None:
            made = cut_lineage(_compared(now, sets, near))
        else:  # components that are as they were keep their links
            was = now.join(inside.select("cid", F.col("label").alias("was")), "cid", "left")
            grown = was.groupBy("label").agg(F.min("was").alias("x"), F.max("was").alias("y"), F.count_if(F.col("was").isNull()).alias("new")).filter("new > 0 OR x <> y")
            again = cut_lineage(now.join(grown.select("label"), "label", "left_semi"), most)
            made = _compared(again, sets, near).union(linked.join(again.select("cid"), "cid", "left_anti"))
            old, made = linked, cut_lineage(made)
            free(inside, old, again)
        if own is not ties:
            free(own)
        inside, linked = now, made
        seen = np.array(linked.agg(F.array(*[F.sum(F.col("alike")[k]) for k in range(ALIKE)])).first()[0], dtype=float)
        links = np.nan_to_num(seen)
        report = {"depth": depth, "links": int(links.sum()) // 2, "recall": expected_recall(links, near, depth, depth)}
        if report["recall"] >= near.target or depth == near.shortest:
            break
        # as long as the links found so far let it reach the target
        depth = next((d for d in range(depth - 1, near.shortest, -1) if expected_recall(links, near, depth, d) >= near.target), near.shortest)
    free(ties, sets, inside)
    groups = components(linked.filter("cid <> tie").select(F.col("cid").alias("a"), F.col("tie").alias("b")), most=linked.count())
    counts = linked.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    out = (
        classes.select("cid", "k1", "k2", "copies", "rep").join(counts, "cid", "left").join(groups.withColumnRenamed("id", "cid"), "cid", "left")
        .select("cid", "k1", "k2", "copies", "rep", F.coalesce("label", "cid").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("others", F.lit(0)).alias("others"))
    )
    whole = cut_lineage(out, units_n)
    free(classes, linked)
    return units, whole, report
