"""Cleaning operations on documents: one row per document with path, class, text and rid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions import fixed
from siltwork.functions import texts as X
from siltwork.operators.near import near_text_groups
from siltwork.operators.registry import RID, Param, PlanError, keep_first, op
from siltwork.session import cut_lineage

#: bytes of repeated lines that go to every task; more are joined
LINES_BYTES = 1 << 20
THRESHOLD = Param(float, 0.8, 0.5, 1)


def _text(df: DataFrame, f) -> DataFrame:
    return df.withColumn("text", f(F.col("text")))


@op("text", "fix_encoding", "safe", "UTF-8 read as Windows-1252 is read again")
def fix_encoding(df, columns):
    return _text(df, X.fix_mojibake)


@op("text", "normalize_unicode", "safe", "compatible characters in one form")
def normalize_unicode(df, columns):
    return _text(df, X.nfkc)


@op("text", "strip_html", "safe", "markup goes", params={"unclosed": Param(bool, True)})
def strip_html(df, columns, unclosed):
    return _text(df, lambda c: X.strip_html(c, unclosed))


@op("text", "normalize_whitespace", "safe", "one space, one blank line")
def normalize_whitespace(df, columns):
    return _text(df, X.normalize_whitespace)


def line_counts(df: DataFrame) -> DataFrame:
    """(line, docs): in how many documents each line of 8 characters or more occurs."""
    lines = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return df.select(F.explode(F.filter(lines, lambda x: F.length(x) >= 8)).alias("line")).groupBy("line").agg(F.count("*").alias("docs"))


def repeated_lines(df: DataFrame, min_share: float = 0.3, min_docs: int = 3) -> DataFrame:
    total = df.agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(min_docs), F.ceil(F.lit(min_share) * F.col("n")))
    return line_counts(df).join(F.broadcast(total), F.col("docs") >= least).select("line", "docs", (F.col("docs") / F.col("n")).alias("share"))


@op("text", "strip_boilerplate", "lossy", "lines that many documents share go", params={"min_share": Param(float, 0.3, 0.1, 1)})
def strip_boilerplate(df, columns, min_share):
    lines = cut_lineage(repeated_lines(df, min_share).select("line"))
    size = lines.agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes")).first()
    if not size["n"]:
        return df
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    if size["bytes"] <= LINES_BYTES:  # one row with all of them goes to every task
        every = lines.agg(F.collect_set("line").alias("__lines"))
        kept = F.filter(F.split("text", r"\R"), lambda x: ~F.array_contains("__lines", bare(x)))
        return df.join(F.broadcast(every)).withColumn("text", bare(F.array_join(kept, "\n"))).drop("__lines")
    cut = df.select(RID, F.posexplode(F.split("text", r"\R")).alias("k", "x")).join(lines.withColumnRenamed("line", "b"), bare(F.col("x")) == F.col("b"), "left_anti")
    joined = cut.groupBy(RID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), "\n").alias("__text"))
    text = F.when(F.col("text").isNotNull(), bare(F.coalesce("__text", F.lit(""))))
    return df.join(joined, RID, "left").withColumn("text", text).drop("__text")


@op("text", "mask_pii", "lossy", "private data is masked")
def mask_pii(df, columns):
    return _text(df, X.mask_pii)


@op("text", "truncate_long_documents", "lossy", "no more than so many words", params={"max_words": Param(int, 2000, 50, 100_000)})
def truncate_long_documents(df, columns, max_words):
    return _text(df, lambda c: X.truncate_words(c, max_words))


@op("text", "drop_exact_duplicates", "destructive", "the first of documents with equal words stays")
def drop_exact_duplicates(df, columns):
    return keep_first(df, X.dedupe_key(F.col("text")))


@op("text", "drop_near_duplicates", "destructive", "the first of similar documents stays", params={"threshold": THRESHOLD})
def drop_near_duplicates(df, columns, threshold):
    gone = near_text_groups(df, threshold).filter(F.col("id") != F.col("label")).select(F.col("id").alias(RID))
    return df.join(gone, RID, "left_anti")


@op("text", "drop_cross_label_duplicates", "destructive", "similar documents of several classes go", params={"threshold": THRESHOLD})
def drop_cross_label_duplicates(df, columns, threshold):
    groups = near_text_groups(df, threshold)
    named = groups.join(df.select(F.col(RID).alias("id"), F.coalesce("class", F.lit("")).alias("class")), "id")
    mixed = named.groupBy("label").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z").select("label")
    gone = named.filter("class <> ''").join(mixed, "label", "left_semi").select(F.col("id").alias(RID))
    return df.join(gone, RID, "left_anti")


@op("text", "drop_short_documents", "destructive", "documents with fewer words go", params={"min_words": Param(int, 5, 1, 500)})
def drop_short_documents(df, columns, min_words):
    return df.filter(X.word_count(F.col("text")) >= min_words)


@op("text", "filter_language", "destructive", "documents of other languages go", params={"languages": Param(list, most=10), "keep_unknown": Param(bool, True)})
def filter_language(df, columns, languages, keep_unknown):
    codes = {fixed.LANGUAGE_NAMES.get(x.strip().lower(), x.strip().lower()) for x in languages}
    if bad := codes - set(fixed.LANGUAGE_NAMES.values()):
        raise PlanError(f"filter_language: unknown language {', '.join(sorted(bad))}")
    return df.filter(X.language(F.col("text")).isin(*codes, *(["unknown"] if keep_unknown else [])))


def existing(df: DataFrame, paths: list[str], known: DataFrame | None = None) -> None:
    """Each path is one of the data, or of known, where rows may be gone already."""
    asked = df.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    if missing := [r["path"] for r in asked.join((known or df).select("path"), "path", "left_anti").collect()]:
        raise PlanError(f"no such path: {', '.join(sorted(missing)[:5])}")


@op("text", "drop_documents", "destructive", "named documents go", params={"documents": Param(list, most=500)}, names_rows=True)
def drop_documents(df, columns, documents, known=None):
    existing(df, documents, known)
    return df.filter(~F.col("path").isin(*documents))


@op("text", "flag_suspected_mislabels", "safe", "named documents are flagged", params={"documents": Param(list, most=500)}, names_rows=True)
def flag_text_mislabels(df, columns, documents, known=None):
    existing(df, documents, known)
    return flag_paths(df, documents)


def flag_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    old = F.coalesce("suspected_mislabel", F.lit(False)) if "suspected_mislabel" in df.columns else F.lit(False)
    return df.withColumn("suspected_mislabel", old | F.col("path").isin(*paths))
