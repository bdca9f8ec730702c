"""Tables that name files: which rows and files belong together, and whether their labels agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import values as V


def keys_of(path: Column) -> Column:
    """Path, name and stem of a file, as (rank, key)."""
    p = V.file_key(path)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.array(*[F.struct(F.lit(k).alias("rank"), c.alias("key")) for k, c in enumerate((p, name, stem))])


def link(rows: DataFrame, column: str, files: DataFrame, row_id: str = "rid") -> DataFrame:
    """(row_id, path): the file each value names; by path, else by name, else by stem; several that fit by name count
    only if one of their paths ends with the value."""
    value = V.file_key(F.col(f"`{column}`"))
    asked = rows.select(F.col(row_id), value.alias("value")).filter("value <> ''")
    index = files.select("path", F.explode(keys_of(F.col("path"))).alias("k")).select("path", "k.rank", "k.key").distinct()
    unique = index.groupBy("rank", "key").agg(F.count("*").alias("n"), F.min("path").alias("one"))
    name = F.regexp_extract("value", r"([^/]*)$", 1)
    tries = asked.withColumn("t", F.explode(F.array(*[
        F.struct(F.lit(0).alias("rank"), F.col("value").alias("key")), F.struct(F.lit(1).alias("rank"), name.alias("key")),
        F.struct(F.lit(2).alias("rank"), F.regexp_replace(name, r"\.[^.]*$", "").alias("key")),
    ]))).select(row_id, "value", "t.rank", "t.key")
    single = tries.join(unique.filter("n = 1"), ["rank", "key"]).select(row_id, "rank", F.col("one").alias("path"))
    # of files with one name, the one whose path ends with the value; each end of a path is a key, so that no row meets all of them
    parts = F.split(V.file_key(F.col("path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    ending = files.select("path", F.explode(ends).alias("value")).distinct().groupBy("value").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    decided = asked.join(ending, "value").select(row_id, F.lit(1).alias("rank"), "path")
    return single.union(decided).groupBy(row_id).agg(F.min_by("path", "rank").alias("path"))


def file_column(df: DataFrame, files: DataFrame, least: int = 3, share: float = 0.5) -> tuple[str, float] | None:
    """The column whose values name files most often, and the share of its values that do."""
    best = None
    for c in [c for c in df.columns if c != "rid"]:
        given = df.filter(~V.is_missing(F.col(f"`{c}`")))
        n = given.count()
        if n >= least:
            hit = link(given, c, files).count() / n
            if hit >= share and (best is None or hit > best[1]):
                best = (c, round(hit, 4))
    return best


def link_facts(df: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """Rows that name a file that isn't there, files no row names, files named more than once."""
    found = link(df, column, files)
    given = df.filter(~V.is_missing(F.col(f"`{column}`")))
    missing = given.join(found, "rid", "left_anti").agg(F.count("*").alias("missing_files"))
    unnamed = files.join(found.select("path"), "path", "left_anti").agg(F.count("*").alias("unreferenced_files"))
    twice = found.groupBy("path").count().filter("count > 1").agg(F.count("*").alias("referenced_twice"))
    return missing.join(F.broadcast(unnamed)).join(F.broadcast(twice))


def label_disagreements(df: DataFrame, column: str, label: str, files: DataFrame) -> DataFrame:
    """Rows whose label isn't the folder (class) of the file they name."""
    found = link(df, column, files).join(files.select("path", "class"), "path")
    told = df.select("rid", F.col(f"`{label}`").alias("label")).join(found, "rid")
    return told.filter(V.normalized_label(F.col("label")) != V.normalized_label(F.col("class"))).select("rid", "path", "label", "class")


def align(before: DataFrame, after: DataFrame, key: str = "rid") -> DataFrame:
    """Rows of both, side by side as structs; either is null where a row is gone or new."""
    b = before.select(F.col(key).alias("k"), F.struct(*[F.col(f"`{c}`") for c in before.columns]).alias("before"))
    a = after.select(F.col(key).alias("k"), F.struct(*[F.col(f"`{c}`") for c in after.columns]).alias("after"))
    return b.join(a, "k", "full")


def class_loss(before: DataFrame, after: DataFrame, label: str = "class", share: float = 0.5, least: int = 5) -> DataFrame:
    """Classes of some size that lose more than a share of their members."""
    b = before.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("before"))
    a = after.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("after"))
    both = b.join(a, "class", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return both.filter((F.col("before") >= least) & (F.col("before") - F.col("after") > share * F.col("before")))


def quotas(counts: DataFrame, total: int, least: int = 5) -> DataFrame:
    """counts (g, n) -> (g, quota): how many of each group to sample, `total` in all, or all where there are fewer.

    Each group has a floor of `least`, or its size. Where the floors fit, the rest is shared in proportion to what groups
    have beyond their floors, whole shares first, then one each by the largest remainder; where they don't, the largest
    groups have theirs first. Groups are few (folders, classes), so that their running sums are those of one small table.
    """
    g = counts.withColumn("floor", F.least("n", F.lit(least)))
    every = W.partitionBy()
    g = g.withColumns({"all": F.sum("n").over(every), "left": F.lit(total) - F.sum("floor").over(every), "spare": F.col("n") - F.col("floor")})
    exact = F.col("left") * F.col("spare") / F.nullif(F.sum("spare").over(every), F.lit(0))
    g = g.withColumn("exact", F.coalesce(exact, F.lit(0.0))).withColumn("whole", F.floor("exact"))
    g = g.withColumn("over", F.col("left") - F.sum("whole").over(every))
    by_size = W.orderBy(F.desc("n"), "g").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("floor").over(by_size) - F.col("floor")
    first = F.row_number().over(W.orderBy(F.desc(F.col("exact") - F.col("whole")), "g")) <= F.col("over")
    shared = F.col("floor") + F.col("whole") + first.cast("int")
    scarce = F.greatest(F.lit(0), F.least(F.col("floor"), F.lit(total) - before))
    quota = F.when(F.col("all") <= total, F.col("n")).when(F.col("left") <= 0, scarce).otherwise(shared)
    return g.select("g", quota.cast("long").alias("quota"))


def stratified_sample(df: DataFrame, group: str, total: int, key: str = "path", seed: int = 42, least: int = 5) -> DataFrame:
    """Rows of each group by its quota, in the order of a hash."""
    q = quotas(df.groupBy(F.col(f"`{group}`").alias("g")).agg(F.count("*").alias("n")), total, least)
    rank = F.row_number().over(W.partitionBy(f"`{group}`").orderBy(F.xxhash64(F.lit(seed), key), key))
    # no group gives more than the total, so that each task keeps no more of it
    ranked = df.withColumn("__rank", rank).filter(F.col("__rank") <= total)
    return ranked.join(q, F.col(f"`{group}`").eqNullSafe(F.col("g"))).filter("__rank <= quota").drop("__rank", "g", "quota")


def evenly_spaced(df: DataFrame, most: int, key: str = "rid") -> DataFrame:
    """At most so many rows at even distances in the order of the key, the first and the last among them."""
    from siltwork.operators.profile import numbered

    placed = numbered(df, key, "__place")
    n = placed.agg(F.max("__place")).first()[0]
    if n is None or n + 1 <= most:
        return placed.drop("__place")
    if most == 1:
        return placed.filter("__place = 0").drop("__place")
    # the i-th of them is at i * n // (most - 1), in whole numbers
    at = F.expr(f"(__place * {most - 1} + {n} - 1) DIV {n}")
    return placed.filter((at * n - at * n % (most - 1)) / (most - 1) == F.col("__place")).drop("__place")
