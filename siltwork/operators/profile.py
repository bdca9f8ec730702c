"""Profiles of tables: kinds of columns, statistics, correlations, leakage, drift, quality."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import fixed as X
from siltwork.functions import values as V
from siltwork.operators.registry import RID
from siltwork.session import cut_lineage, free

#: counts of values that one task puts in order
FEW = 1 << 19
NUMERIC = ("numeric", "currency", "percent")


@dataclass(frozen=True)
class Kind:
    kind: str
    parse_rate: float = 1.0
    detail: str = ""


def _own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value, as a string, occurs in each column.

    All columns in one long table and one shuffle, partly counted before it; whatever is asked of values is asked of the
    distinct ones only.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def detect_kinds(df: DataFrame) -> dict[str, Kind]:
    """What each column of strings holds, from shares of all its values that match."""
    cols = _own(df)
    if not cols:
        return {}
    trimmed = value_counts(df, cols).select("column", V.present(F.col("value")).alias("v"), "n")
    c = trimmed.groupBy("column", "v").agg(F.sum("n").alias("n"))
    v, n, low = F.col("v"), F.col("n"), F.lower("v")

    def times(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    stats = c.groupBy("column").agg(
        times(v.isNotNull()).alias("n"), F.count(v).alias("distinct"), F.min(v).alias("least"), F.sum(n).alias("rows"),
        F.coalesce(F.bool_and(low.isin(*X.BOOLEAN_WORDS)), F.lit(False)).alias("words"), F.coalesce(F.bool_and(low.isin("0", "1")), F.lit(False)).alias("bits"),
        times(V.full_match(v, X.PERCENT)).alias("percent"), times(V.full_match(v, X.CURRENCY)).alias("currency"), times(V.full_match(v, X.NUMBER_US)).alias("us"),
        times(V.full_match(v, X.NUMBER_EU)).alias("eu"), times(V.full_match(v, X.INTEGER)).alias("int"), times(v.rlike(X.DATE_HINT)).alias("hint"),
        times(v.rlike(X.DATE_HINT) & V.to_timestamp(v).isNotNull()).alias("dates"), times(V.full_match(v, X.ID_VALUE)).alias("idlike"),
        F.sum(F.length(v) * n).alias("chars"),
    )
    found = {r["column"]: r for r in stats.collect()}
    return {x: _kind(x, found[x]) if x in found else Kind("empty") for x in cols}


def _kind(name: str, s) -> Kind:
    import re

    n, named = s["n"], bool(re.search(X.ID_NAME, name))
    if n == 0:
        return Kind("empty")
    share = {k: s[k] / n for k in ("percent", "currency", "us", "eu", "int", "hint", "dates", "idlike", "distinct")}
    if s["distinct"] == 1 and s["rows"] > 1:
        return Kind("constant", detail=f"always '{s['least']}'")
    if s["words"] or s["bits"] and s["distinct"] == 2:
        return Kind("boolean")
    if share["percent"] >= 0.9:
        return Kind("percent", share["percent"])
    if share["currency"] >= 0.9 or share["currency"] >= 0.5 and share["currency"] + share["us"] >= 0.9:
        return Kind("currency", min(1.0, share["currency"] + share["us"]))
    both = share["us"] + share["eu"]
    if both >= 0.9:
        if share["int"] == 1 and share["distinct"] >= 0.9 and named:
            return Kind("id", both)
        return Kind("numeric", both, "decimal comma" if s["eu"] > 0 and s["eu"] > 0.5 * s["us"] else "")
    if share["hint"] >= 0.8 and share["dates"] >= 0.8:
        return Kind("datetime", share["dates"])
    if share["distinct"] >= 0.95 and n >= 20 and (named or share["idlike"] >= 0.95):
        return Kind("id")
    return Kind("text" if s["chars"] > 40 * n and share["distinct"] > 0.5 else "category")


def adjusted_skew(v: Column) -> Column:
    """Skewness with the correction for small samples; null for fewer than three values or no spread."""
    n = F.count(v)
    return F.when((n > 2) & (F.stddev_samp(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def placed_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, before): how often each number occurs in each column, and how many of its numbers are smaller.

    Counts are partly summed before the shuffle, and running sums are those of ranges, so that no task holds a column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = running_total(counts, ["column", "value"], "n")
    first = placed.groupBy("column").agg(F.min("before").alias("first"))  # a row per column
    return placed.join(F.broadcast(first), "column").select("column", "value", "n", (F.col("before") - F.col("first")).alias("before"))


def quantiles(placed: DataFrame, probabilities: list[float]) -> DataFrame:
    """placed_values -> column, n, q: exact quantiles, between neighbours in proportion."""
    sizes = placed.groupBy("column").agg(F.sum("n").alias("all"))
    r = placed.join(F.broadcast(sizes), "column")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))

    found = []
    for p in probabilities:
        pos = F.lit(p) * (F.col("all") - 1)
        found.append(F.struct(at(F.floor(pos)).alias("a"), at(F.ceil(pos)).alias("b"), F.max(pos - F.floor(pos)).alias("w")))
    out = r.groupBy("column").agg(F.max("all").alias("n"), F.array(*found).alias("f"))
    return out.select("column", "n", F.transform("f", lambda x: x["a"] + (x["b"] - x["a"]) * x["w"]).alias("q"))


def quantile_values(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """The same on the driver; columns without a number are left out."""
    return {r["column"]: list(r["q"]) for r in quantiles(placed_values(df, columns), probabilities).collect()} if columns else {}


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median of an expression, from counts per value; null if there is none."""
    return quantile_values(df.select(value.cast("double").alias("v")), ["v"], [0.5]).get("v", [None])[0]


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per numeric column with counts, moments and quartiles; moments from one pass, the rest from counts per value."""
    first = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        first.append(F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), (F.count("*") - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            F.max(v).alias("max"), adjusted_skew(v).alias("skew"), F.count_if(v < 0).alias("negatives"), F.count_if(v == 0).alias("zeros"),
        ).alias(c))
    moments = df.agg(*first)
    long = moments.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("s")).select("s.*")
    placed = placed_values(df, columns)
    q = quantiles(placed, [0.25, 0.5, 0.75]).select("column", "q")
    q1, q3 = F.col("q")[0], F.col("q")[2]
    beyond = (F.col("value") < q1 - 1.5 * (q3 - q1)) | (F.col("value") > q3 + 1.5 * (q3 - q1))
    # a row per column
    told = placed.join(F.broadcast(q), "column").groupBy("column").agg(F.count("*").alias("unique"), F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outliers_iqr"), F.first("q").alias("q"))
    n = F.col("rows") - F.col("missing")
    outliers = F.coalesce("outliers_iqr", F.lit(0))
    return long.join(F.broadcast(told), "column", "left").select(
        "column", "rows", "missing", F.coalesce("unique", F.lit(0)).alias("unique"), V.r4(F.col("mean")).alias("mean"), V.r4(F.col("std")).alias("std"), V.r4(F.col("min")).alias("min"),
        V.r4(F.col("q")[0]).alias("p25"), V.r4(F.col("q")[1]).alias("median"), V.r4(F.col("q")[2]).alias("p75"), V.r4(F.col("max")).alias("max"), V.r4(F.col("skew")).alias("skew"),
        outliers.alias("outliers_iqr"), V.r4(F.when(n > 0, 100 * outliers / n)).alias("outliers_pct"), "negatives", "zeros",
    )


def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column of dates written as text: values, least and greatest date, and values that are none."""
    counts = value_counts(df, columns).withColumn("v", V.present(F.col("value"))).filter("v IS NOT NULL").withColumn("t", V.to_timestamp(F.col("v")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("present"), F.date_format(F.min("t"), "yyyy-MM-dd").alias("min"), F.date_format(F.max("t"), "yyyy-MM-dd").alias("max"), F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)).alias("unparseable"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """A row per column, whatever its type: missing, hidden missing, unique values, lengths."""
    c = value_counts(df, _own(df)).withColumn("v", V.present(F.col("value")))
    n, v = F.col("n"), F.col("v")
    c = c.groupBy("column", "v").agg(
        F.sum(n).alias("n"), F.sum(F.when(V.is_hidden_missing(F.col("value")), n).otherwise(0)).alias("hidden")
    )
    out = c.groupBy("column").agg(
        F.sum(n).alias("rows"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("missing"), F.sum("hidden").alias("hidden_missing"), F.count(v).alias("unique"),
        (F.sum(F.length(v) * n) / F.sum(F.when(v.isNotNull(), n))).alias("avg_length"), F.max(F.length(v)).cast("long").alias("max_length"),
    )
    rows = F.nullif(F.col("rows"), F.lit(0))
    return out.select(
        "column", "rows", "missing", V.r4(100 * F.col("missing") / rows).alias("missing_pct"), "hidden_missing", "unique",
        V.r4(100 * F.col("unique") / rows).alias("unique_pct"), V.r4(F.col("avg_length")).alias("avg_length"), "max_length",
    )


def table_overview(df: DataFrame) -> DataFrame:
    cols = _own(df)
    groups = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("n"))
    rows, dup = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return groups.agg(rows.alias("rows"), F.lit(len(cols)).cast("long").alias("columns"), dup.alias("duplicate_rows"), V.r4(F.when(rows > 0, 100 * dup / rows).otherwise(0)).alias("duplicate_pct"))


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    v = F.trim(F.col(f"`{column}`").cast("string"))
    return df.filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def case_variants(df: DataFrame, column: str) -> DataFrame:
    v = V.present(F.col(f"`{column}`"))
    return df.agg((F.countDistinct(v) - F.countDistinct(F.lower(v))).alias("case_variants"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson coefficients of all pairs of columns over rows with both values; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = []
    for a, b in pairs:
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        made.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(x, y).alias("r"), F.count_if(both).alias("n")))
    return df.agg(F.array(*made).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b", V.r4(F.col("p.r")).alias("r"), "p.n")


def average_ranks(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(value, name): the mean rank of each distinct value, from counts per value.

    Counts first, then a running sum over the distinct values: ranges of values are summed apart and shifted, so that no
    single task holds all of them.
    """
    counts = df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("c"))
    return running_total(counts, "value", "c").select("value", (F.col("before") + (F.col("c") + 1) / 2).alias(name))


def ranged(df: DataFrame, order: list[str], parts: int = 0) -> DataFrame:
    """df in ranges of the order, with the number of its range in __part; written, so that ranges stay as they are."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def running_total(df: DataFrame, order: str | list[str], amount: str, parts: int = 0) -> DataFrame:
    """df and before: the sum of amount over rows with smaller order; by ranges, each of which is one task's work, or in one
    task if there are FEW rows at most."""
    keys = [order] if isinstance(order, str) else order
    counted = cut_lineage(df)
    if counted.count() <= FEW:
        return counted.withColumn("before", F.coalesce(F.sum(amount).over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    held = ranged(counted, keys, parts)
    free(counted)
    sums = held.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    offset = sums.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inner = F.coalesce(F.sum(amount).over(W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("before", inner).join(F.broadcast(offset), "__part").withColumn("before", F.col("before") + F.col("__offset")).drop("__part", "__offset")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df and the place of each row in the order of the key, from 0."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), key, "__one").withColumnRenamed("before", name).drop("__one")


def strong_correlations(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Pairs of columns whose Pearson coefficient is at least so far from 0, the farthest first."""
    return correlations(df, columns).filter(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "a", "b")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns over rows with both values."""
    both = df.select(F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")).na.drop()
    rx = average_ranks(both, F.col("x"), "rx").withColumnRenamed("value", "x")
    ry = average_ranks(both, F.col("y"), "ry").withColumnRenamed("value", "y")
    return both.join(rx, "x").join(ry, "y").agg(V.r4(F.corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman coefficients of all pairs of columns, each over the rows with both values, in a number of jobs that doesn't
    grow with the columns.

    Ranks of a column are among the rows where the other one has a value, so that a column has one list of ranks for each
    column with missing values, and one for all others. All lists are ranked together, as counts per value in ranges; ranks
    go back to the rows and are multiplied there, list by list.
    """
    none = df.agg(*[F.count_if(F.col(f"`{c}`").cast("double").isNull()).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    masks = [-1, *[k for k in range(len(columns)) if none[f"c{k}"]]]
    lists = {(k, m): n for n, (k, m) in enumerate((k, m) for k in range(len(columns)) for m in masks if k != m)}
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    cells = F.array(*[
        F.struct(F.lit(n).alias("list"), numbers[k].alias("value")) if m < 0 else F.struct(F.lit(n).alias("list"), F.when(numbers[m].isNotNull(), numbers[k]).alias("value")) for (k, m), n in lists.items()
    ])
    whole = df.select(F.monotonically_increasing_id().alias("row"), cells.alias("c"))
    rows = cut_lineage(whole.select("row", F.explode("c").alias("c")).select("row", "c.*").filter("value IS NOT NULL"))
    counts = rows.groupBy("list", "value").agg(F.count("*").alias("n"))
    placed = running_total(counts, ["list", "value"], "n")
    first = placed.groupBy("list").agg(F.min("before").alias("first"), F.sum("n").alias("all"))  # a row per list
    # ranks less their mean, so that sums of products are all that is needed
    rank = F.col("before") - F.col("first") + (F.col("n") + 1) / 2 - (F.col("all") + 1) / 2
    ranks = placed.join(F.broadcast(first), "list").select("list", "value", rank.alias("rank"))
    by_row = rows.join(ranks, ["list", "value"]).groupBy("row").agg(F.collect_list("list").alias("l"), F.collect_list("rank").alias("r"))
    size = len(lists)

    def products(batches):
        total, both = np.zeros((size, size)), np.zeros((size, size))
        for b in batches:
            x, own = np.zeros((len(b), size)), np.zeros((len(b), size))
            at = np.repeat(np.arange(len(b)), b["l"].map(len).to_numpy())
            if len(at):
                place = np.concatenate(b["l"].to_numpy())
                x[at, place], own[at, place] = np.concatenate(b["r"].to_numpy()), 1
            total += x.T @ x
            both += own.T @ own
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j], "n": both[i, j].astype(np.int64)})

    summed = by_row.mapInPandas(products, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    squares = summed.filter("i = j").select("i", F.col("s").alias("q"))
    pairs = []
    for a in range(len(columns)):
        for b in range(a + 1, len(columns)):
            x, y = lists[a, b if none[f"c{b}"] else -1], lists[b, a if none[f"c{a}"] else -1]
            pairs.append((columns[a], columns[b], min(x, y), max(x, y)))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, rho double, n long")
    asked = df.sparkSession.createDataFrame(pairs, "a string, b string, i int, j int")
    told = asked.join(summed, ["i", "j"], "left").join(squares.withColumnRenamed("q", "qi"), "i", "left").join(squares.select(F.col("i").alias("j"), F.col("q").alias("qj")), "j", "left")
    return told.select("a", "b", V.r4(F.when((F.col("qi") > 0) & (F.col("qj") > 0), F.col("s") / F.sqrt(F.col("qi") * F.col("qj")))).alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))


def aucs(df: DataFrame, features: list[str], positive: Column) -> DataFrame:
    """(column, auc, n): the area under the curve of every feature for one binary target, as `auc` does one; all features
    are ranked together."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in features])
    long = df.select(positive.cast("boolean").alias("p"), F.explode(cells).alias("c")).select("p", "c.*").na.drop()
    counts = long.groupBy("column", "v").agg(F.count("*").alias("c"), F.count_if("p").alias("pos"))
    placed = running_total(counts, ["column", "v"], "c")
    first = placed.groupBy("column").agg(F.min("before").alias("first"))  # a row per column
    ranked = placed.join(F.broadcast(first), "column").withColumn("rank", F.col("before") - F.col("first") + (F.col("c") + 1) / 2)
    n, n1 = F.sum("c"), F.sum("pos")
    value = (F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2) / (n1 * (n - n1))
    return ranked.groupBy("column").agg(V.r4(F.when((n1 > 0) & (n1 < n), value)).alias("auc"), n.cast("long").alias("n"))


def purities(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, values, min_purity, n): what `purity` says of each column, from one table of counts."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    long = df.select(F.col(f"`{target}`").alias("t"), F.explode(cells).alias("c")).select("t", "c.*").na.drop()
    per = long.groupBy("column", "v", "t").agg(F.count("*").alias("n")).groupBy("column", "v").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return per.groupBy("column").agg(F.count("*").alias("values"), V.r4(F.min(F.col("top") / F.col("all"))).alias("min_purity"), F.sum("all").alias("n"))


def auc(df: DataFrame, feature: str, positive: Column) -> DataFrame:
    """Area under the curve of one feature for a binary target, with ties at half; from counts per value."""
    v = df.select(F.col(f"`{feature}`").cast("double").alias("v"), positive.cast("boolean").alias("p")).na.drop()
    counts = v.groupBy("v").agg(F.count("*").alias("c"), F.count_if(F.col("p")).alias("pos"))
    ranked = running_total(counts, "v", "c").withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)
    n, n1 = F.sum("c"), F.sum("pos")
    value = (F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2) / (n1 * (n - n1))
    return ranked.agg(V.r4(F.when((n1 > 0) & (n1 < n), value)).alias("auc"), n.cast("long").alias("n"))


def purity(df: DataFrame, column: str, target: str) -> DataFrame:
    """The least share, over values of column, of their most frequent target class."""
    cells = df.na.drop("any", subset=[column, target]).groupBy(F.col(f"`{column}`").alias("v"), F.col(f"`{target}`").alias("t")).agg(F.count("*").alias("n"))
    per = cells.groupBy("v").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return per.agg(F.count("*").alias("values"), V.r4(F.min(F.col("top") / F.col("all"))).alias("min_purity"), F.sum("all").alias("n"))


def leaks(df: DataFrame, target: str, numeric: list[str], categories: list[str]) -> list[tuple[str, str, float]]:
    """Columns that give the target away: (column, how, value); all columns in the same few jobs."""
    t = F.col(f"`{target}`")
    facts = df.agg(F.count(t).alias("n"), F.countDistinct(t).alias("k"), F.max(t).alias("top")).first()
    out: list[tuple[str, str, float]] = []
    if facts["n"] < 20:
        return out
    as_number = df.schema[target].dataType.typeName() not in ("string", "boolean")
    number = t.cast("double") if as_number else F.lit(None).cast("double")
    r = df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), number).alias(f"c{k}") for k, c in enumerate(numeric)]).first() if numeric and as_number else {}
    close = {c: r[f"c{k}"] for k, c in enumerate(numeric) if r and r[f"c{k}"] is not None and abs(r[f"c{k}"]) >= 0.95}
    ranked = [c for c in numeric if c not in close] if facts["k"] == 2 else []
    areas = {x["column"]: x["auc"] for x in aucs(df, ranked, t == F.lit(facts["top"])).collect()} if ranked else {}
    for c in numeric:
        a = areas.get(c)
        if c in close:
            out.append((c, "correlation", round(close[c], 4)))
        elif a is not None and max(a, 1 - a) >= 0.97:
            out.append((c, "auc", max(a, 1 - a)))
    pure = {x["column"]: x for x in purities(df, categories, target).collect()} if categories else {}
    for c in categories:
        p = pure.get(c)
        if p is not None and p["n"] >= 20 and p["values"] >= 2 and p["values"] < 0.5 * p["n"] and p["min_purity"] >= 0.999:
            out.append((c, "purity", p["min_purity"]))
    return out


def guess_target(columns: list[str], goal: str = "") -> str | None:
    """The longest column named in the goal, else a usual name of a target."""
    named = [c for c in columns if c and c.lower().replace("_", " ") in goal.lower().replace("_", " ")]
    if named:
        return max(named, key=len)
    usual = ("target", "label", "class", "outcome", "churn", "churned", "survived", "default", "y")
    return next((c for u in usual for c in columns if c.lower() == u), None)


def class_balance(df: DataFrame, column: str) -> DataFrame:
    v = F.trim(F.col(f"`{column}`").cast("string"))
    n = df.filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", V.r4(100 * F.col("n") / F.sum("n").over(W.partitionBy())))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Largest gap between the distribution functions of a column in two tables."""
    v = F.col(f"`{column}`").cast("double")
    both = a.select(v.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(v.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).filter("v IS NOT NULL")
    per = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # both sums in one scan: the counts of a table are below 2^40, those of the other stand above them
    one = running_total(per.withColumn("both", F.col("a").cast("decimal(38,0)") * (1 << 40) + F.col("b")), "v", "both")
    low = F.col("before").cast("decimal(38,0)") % F.lit(1 << 40).cast("decimal(38,0)")
    rb = one.select("v", "a", "b", ((F.col("before") - low) / F.lit(1 << 40).cast("decimal(38,0)")).cast("long").alias("ba"), low.cast("long").alias("bb"))
    total = rb.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs((F.col("ba") + F.col("a")) / F.col("na") - (F.col("bb") + F.col("b")) / F.col("nb"))
    return rb.join(F.broadcast(total)).agg(V.r4(F.max(gap)).alias("ks"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Bins by the rule of Freedman and Diaconis, between 6 and 40; logarithmic where the values call for it."""
    v = F.col(f"`{column}`").cast("double")
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    empty = df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    if not s["n"]:
        return empty
    lo, hi, (p1, q1, q2, q3, p99) = s["lo"], s["hi"], quantile_values(df, [column], [0.01, 0.25, 0.5, 0.75, 0.99])[column]
    x, own = v, v.isNotNull()
    if lo > 0 and p99 > 20 * q2:
        x = F.log10(v)
        lo, hi = math.log10(lo), math.log10(hi)
        q1, q3 = math.log10(q1), math.log10(q3)
    elif q3 > q1:
        a, b = (p1 if lo < q1 - 6 * (q3 - q1) else lo), (p99 if hi > q3 + 6 * (q3 - q1) else hi)
        own, lo, hi = own & (v >= a) & (v <= b), a, b
    width = 2 * (q3 - q1) / s["n"] ** (1 / 3)
    bins = 1 if hi <= lo else 12 if width <= 0 else int(min(40, max(6, math.ceil((hi - lo) / width))))
    step = (hi - lo) / bins if hi > lo else 1.0
    k = F.least(F.floor((x - lo) / step), F.lit(bins - 1)).cast("int")
    return df.filter(own).groupBy(k.alias("bin")).agg(F.count("*").alias("n")).select("bin", (lo + F.col("bin") * step).alias("lo"), (lo + (F.col("bin") + 1) * step).alias("hi"), "n")


def unparseable(df: DataFrame, kinds: dict[str, Kind]) -> DataFrame:
    """(column, unparseable): present values of columns of numbers and dates that are none."""
    cols = [c for c, k in kinds.items() if k.kind in NUMERIC or k.kind == "datetime"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, unparseable long")
    v = value_counts(df, cols).withColumn("v", V.present(F.col("value"))).filter("v IS NOT NULL")
    dates = F.col("column").isin(*[c for c in cols if kinds[c].kind == "datetime"])
    bad = F.when(dates, V.to_timestamp(F.col("v")).isNull()).otherwise(V.to_number(F.col("v")).isNull())
    return v.groupBy("column").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("unparseable"))


def table_shares(df: DataFrame) -> DataFrame:
    """df of strings -> part, amount for scores.deductions(..., 'table')."""
    kinds = detect_kinds(df)
    cols = column_profile(df).agg(F.coalesce(F.avg("missing_pct"), F.lit(0.0)).alias("missing"), F.count_if(F.col("hidden_missing") > 0).alias("hidden"))
    issues = unparseable(df, kinds).agg(F.count_if(F.col("unparseable") > 0).alias("issues"))
    dead = sum(k.kind in ("empty", "constant") for k in kinds.values())
    row = cols.join(issues).join(table_overview(df).select("duplicate_pct"))
    parts = {"missing": F.col("missing"), "duplicates": F.col("duplicate_pct"), "type_issues": F.col("issues"), "empty_or_constant": F.lit(dead), "hidden_missing": F.col("hidden")}
    return row.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), c.cast("double").alias("amount")) for p, c in parts.items()])).alias("s")).select("s.*")
