"""Mix sources to target weights with hash-threshold histograms. DataFrame functions only.

Every document gets a 64-bit hash of its id and text. Per source, sizes are summed by the leading byte of the hash, the
byte in which the budget runs out is found by a running sum over at most 256 sums, and only the documents of that one
bucket are summed again by their next byte, until it holds one document, or hashes that are equal as a whole. Taking
documents is then a filter: below this threshold a document is taken once more than above it, and the one at it gives
the words still missing. No document is ever sorted.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last; documents with equal id and
text have equal hashes, and if the budget runs out among them they share what is left by size; an empty table gives no
rows; columns beyond doc_id, text and source are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.session import FILE_DOCS, cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
LEVELS = 8
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target: shares of the total by weight, none above most times its size.

    Giving the excess of capped sources to the others by weight, until none is above its cap, ends where each target is
    min(cap, level * weight) for one level. Ordered by cap / weight, the capped sources come first, so the level follows
    from running sums over the sources.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cap = F.col("source_size") * F.lit(float(most))
    s = sizes.withColumn("weight", F.element_at(listed, ((rank - 1) % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (
        s.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    level = (F.col("total") - F.col("spent")) / F.col("left_weight")
    # the first source that stays below its cap fixes the level for all that follow
    open_ = F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("place"), level.alias("level")))
    s = s.withColumn("level", F.min(open_).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _hash(doc_id: Column, text: Column, seed: int) -> Column:
    """The first 64 bits of an MD5 sum, as a signed number."""
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16), 16, -10).cast("long")


def _byte(level: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 8 * (7 - level)).bitwiseAND(F.lit(255).cast("long"))


def _lead(n: int) -> Column:
    """The n leading bytes of the hash, as one number."""
    return F.lit(0).cast("long") if n == 0 else F.shiftrightunsigned(F.col("h"), 8 * (8 - n))


def thresholds(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """Per source: how often each document is taken, and up to which hash once more. One row per source."""
    base = cut_lineage(_sized(docs.select("doc_id", "text", "source"), seed).select("source", "size", "h"), docs.count(), FILE_DOCS)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    # whole rounds of the source, then a rest below one round
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - whole * F.col("source_size")).cast("long")
    targets = cut_lineage(targets.select("source", "source_size", "target", whole.alias("rounds"), rest.alias("rest")))
    small = targets.count() <= BROADCAST_SOURCES
    bound = targets.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("need"))
    for level in range(LEVELS):
        inside = base.join(_small(bound, small), F.col("source").eqNullSafe(F.col("of")) & (_lead(level) == F.col("prefix")))
        sums = inside.groupBy("source", "prefix", "need", _byte(level).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        run = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(run))
        bound = sums.filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need"))).select(
            F.col("source").alias("of"),
            F.shiftleft(F.col("prefix"), 8).bitwiseOR(F.col("b")).alias("prefix"),
            (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"),
            F.col("n").alias("at_cut"), "docs",
        )
        bound = cut_lineage(bound)
        if bound.filter("docs > 1").isEmpty():
            break
    cut = bound.select(F.col("of").alias("cut_source"), F.col("prefix").alias("cut"), "need", "at_cut", F.lit(level + 1).alias("bytes"))
    t = targets.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return _small(cut_lineage(t.withColumnRenamed("source", "t_source")), small)


def _small(df: DataFrame, small: bool) -> DataFrame:
    """A table with a row per source goes to all tasks where their number is bounded, else Spark's skew join deals with it."""
    return F.broadcast(df) if small else df


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("h", _hash(F.col("doc_id"), F.col("text"), seed))


def _taken() -> Column:
    flip = F.lit(-(2**63))  # orders the hashes as unsigned numbers
    lead = F.expr("shiftrightunsigned(h, cast(64 - 8 * bytes AS int))")
    below = F.col("cut").isNull() | (lead.bitwiseXOR(flip) < F.col("cut").bitwiseXOR(flip))
    extra = (
        F.when(F.col("rest") <= 0, F.lit(0).cast("long"))
        .when(below, F.col("size"))
        .when(lead == F.col("cut"), F.expr("size * need div greatest(at_cut, 1)"))
        .otherwise(F.lit(0).cast("long"))
    )
    return (F.col("rounds") * F.col("size") + extra).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken: words taken, repeats counted."""
    t = thresholds(docs, weights, most, seed)
    base = _sized(docs.select("doc_id", "text", "source"), seed).drop("text")
    return base.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """The documents of the mix with all their columns, and mix_words: words to take from each, repeats counted."""
    t = thresholds(docs, weights, most, seed)
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c != "mix_words"]
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "doc_id", "text", "source")
    out = _sized(told, seed).join(t, F.col("source").eqNullSafe(F.col("t_source")))
    return out.withColumn("mix_words", _taken()).filter("mix_words > 0").select(*columns, "mix_words")
