"""N-gram Jaccard join of documents with a MinHash LSH forest and exact verification.

Each of `trees` prefix tries holds the signatures of all documents, as labels of `deepest` minima that sort in the order
of the trie. Documents that share a prefix in a trie are candidates; prefixes start at full length and are shortened,
minimum by minimum, until the recall estimated from the verified links reaches the target, or the length with which a
pair at the threshold itself is found with that chance, see near. All candidates are verified exactly.

Result: one row per row of the documents with the class (least doc_id among documents linked directly or over others),
the set of copies (least doc_id with the same words in a row) and the number of documents whose five-word sets have a
Jaccard similarity of 0.8 or more with its own, copies included.

Defined cases: documents without a word (null, empty) have class and copies of their own and no links; documents with a
null id take the class of their copies, and a class of such documents only has a null class_id; fewer than five words
make one shorter shingle; repeated rows are copies of each other; very long texts are hashed whole, in pieces; ties of
ids are told apart by the hash of the text; an empty table gives no rows; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.near import Near, near_classes, recall_at, row_key
from siltwork.session import cut_lineage

TREES, DEEPEST, RECALL = 24, 8, 0.9999


def shortest(threshold: float, trees: int = TREES, deepest: int = DEEPEST, target: float = RECALL) -> int:
    """The longest prefix with which the target recall is reached at the threshold."""
    return next((d for d in range(deepest, 1, -1) if recall_at(threshold, trees, d) >= target), 1)


def forest(threshold: float = 0.8, width: int = 5, trees: int = TREES, deepest: int = DEEPEST, target: float = RECALL) -> Near:
    return Near(groups=trees, deepest=deepest, shortest=shortest(threshold, trees, deepest, target), bytes_each=2, width=width, threshold=threshold, target=target)


def join_with_report(docs: DataFrame, near: Near | None = None) -> tuple[DataFrame, dict]:
    """docs (doc_id, text) -> (doc_id, h, class_id, copy_id, n_links, stays) and the forest's report; h tells rows with one
    id apart, stays marks one (doc_id, h) of each class: the least id, nulls last, then the least h."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units, classes, report = near_classes(docs, near or forest())
    heads = classes.groupBy("label").agg(F.min("rep").alias("first"), F.min("rep.doc_id").alias("class_id"))
    per_class = classes.join(heads, "label").select(
        "k1", "k2", "class_id", F.col("rep.doc_id").alias("copy_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "first"
    )
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    found = units.select("doc_id", "h", "k1", "k2").join(per_class, ["k1", "k2"]).select("doc_id", "h", "class_id", "copy_id", "n_links", stays.alias("stays"))
    own = F.col("doc_id")
    rest = docs.filter(~has_word()).select("doc_id", row_key().alias("h"), own.alias("class_id"), own.alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return found.union(rest), report


def join(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h, class_id, copy_id, n_links."""
    return join_with_report(docs, near)[0].drop("stays")


def has_word() -> Column:
    return F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))


def keep_one(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """docs with one document of each class: that with the least id, those without an id last, then the least hash of
    its text. Documents without a word all stay; of rows that repeat id and text of the one that stays, one does."""
    told = cut_lineage(join_with_report(docs, near)[0])
    lost = told.filter(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    again = told.filter(F.col("stays") & (F.col("n_links") > 0)).groupBy("doc_id", "h").count().filter("count > 1")
    again = again.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (row_key() == F.col("__h"))
    if again.isEmpty():
        return docs.join(lost, key, "left_anti")
    once = docs.join(again, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(lost.union(again), key, "left_anti").unionByName(once)
