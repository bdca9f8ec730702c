"""Logs: lines to records, silences, bursts of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import fixed as X
from siltwork.operators.profile import placed_values, quantiles
from siltwork.operators.scan import running_sum


def log_format(lines: DataFrame, first: int = 500) -> str:
    """The form that most of the first lines have."""
    head = lines.filter(F.trim("value") != "").orderBy("line_no").limit(first)
    row = head.agg(*[F.count_if(F.col("value").rlike(p)).alias(k) for k, (p, _) in X.LOG_FORMATS.items()]).first()
    return max(X.LOG_FORMATS, key=lambda k: row[k] or 0)


def parse_log(lines: DataFrame, name: str | None = None, by: list[str] | None = None) -> DataFrame:
    """lines (line_no, value, and columns `by` that part files) -> a record per line of the form, with those that follow.

    Lines that don't have the form belong to the record before them; those before the first record are left out. Lines are
    numbered by record in ranges, so that one large file is the work of many tasks, and a record may go on over a border.
    """
    name = name or log_format(lines)
    pattern, groups = X.LOG_FORMATS[name]
    by = by or []
    value = F.regexp_replace("value", r"\r$", "")
    kept = lines.filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("value", value).withColumn("hit", F.col("value").rlike(pattern))
    stitched = running_sum(kept, F.col("hit"), "record", ["line_no"], by).filter("record > 0").groupBy(*by, "record").agg(
        F.min("line_no").alias("line_no"), F.min_by("value", "line_no").alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct("line_no", F.trim("value").alias("v"))))).alias("rest"),
    )
    out = [F.regexp_extract("head", pattern, k + 1).alias(g) for k, g in enumerate(groups)]
    key = "message" if "message" in groups else groups[-1]
    more = F.transform("rest", lambda x: x["v"])
    out = [F.trim(F.concat_ws("\n", c, more)).alias(key) if g == key else F.regexp_replace(c, r"^\[|\]$", "").alias(g) if g == "logger" else c for g, c in zip(groups, out)]
    return stitched.select(*by, "line_no", *out, F.size("rest").cast("long").alias("extra_lines"))


def log_facts(df: DataFrame, level: str = "level", source: str = "logger", error: Column | None = None) -> DataFrame:
    """Counts by level, with their share."""
    return df.groupBy(F.upper(level).alias("level")).agg(F.count("*").alias("n")).withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def errors_by_source(df: DataFrame, source: str, error: Column, k: int = 8) -> DataFrame:
    return df.filter(error).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(k)


def steps(df: DataFrame, ts: str, order: str, parts: int = 0) -> DataFrame:
    """Each row with the time of the row before it; by ranges of time, with the last time of each range handed on."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.select(F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("order")).filter("ts IS NOT NULL")
    from siltwork.session import cut_lineage

    ranged = cut_lineage(t.repartitionByRange(n, "ts").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("ts").alias("last"))
    ends = ends.select("part", F.max("last").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("handed"))
    inner = F.lag("ts").over(W.partitionBy("part").orderBy("ts", "order"))
    return ranged.withColumn("inner", inner).join(F.broadcast(ends), "part").select("order", "ts", F.coalesce("inner", "handed").alias("previous"))


def gaps(df: DataFrame, ts: str, order: str, min_seconds: float = 300, factor: float = 20, most: int | None = 3) -> DataFrame:
    """Silences: steps of at least min_seconds and factor times the median step, longest first."""
    from siltwork.session import cut_lineage

    s = cut_lineage(steps(df, ts, order).filter("previous IS NOT NULL").select("previous", "ts", ((F.unix_micros("ts") - F.unix_micros("previous")) / 1e6).alias("seconds")))
    median = quantiles(placed_values(s, ["seconds"]), [0.5]).select(F.col("q")[0].alias("median"), F.col("n"))  # one row
    out = s.join(F.broadcast(median), (F.col("seconds") >= min_seconds) & (F.col("seconds") >= factor * F.col("median")) & (F.col("n") >= 9))
    out = out.select(F.col("previous").alias("start"), F.col("ts").alias("end"), "seconds").orderBy(F.desc("seconds"), "start")
    return out.limit(most) if most else out


def bursts(df: DataFrame, ts: str, error: Column, source: str, bucket_seconds: int = 60, min_errors: int = 3, factor: float = 5, merge_seconds: int = 120, most: int | None = 3) -> DataFrame:
    """Runs of buckets with at least max(min_errors, factor * mean) errors, joined where they are near each other."""
    t = F.col(ts).cast("timestamp")
    at = (F.floor(F.unix_seconds(t) / bucket_seconds) * bucket_seconds).cast("long")
    rows = df.filter(t.isNotNull())
    span = rows.agg(F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.count_if(error).alias("errors"))
    buckets = F.greatest((F.unix_micros("hi") - F.unix_micros("lo")) / 1e6 / bucket_seconds, F.lit(1.0))
    least = span.select("n", F.greatest(F.lit(float(min_errors)), factor * F.col("errors") / buckets).alias("least"))
    per = rows.filter(error).groupBy(at.alias("at"), F.col(source).cast("string").alias("source")).agg(F.count("*").alias("c"))
    totals = per.groupBy("at").agg(F.sum("c").alias("c"))
    hot = totals.join(F.broadcast(least), (F.col("c") >= F.col("least")) & (F.col("n") >= 10)).select("at", "c")
    order = W.orderBy("at")  # hot buckets only, which the threshold keeps few
    fresh = F.coalesce((F.col("at") - F.lag("at").over(order) > merge_seconds).cast("int"), F.lit(1))
    island = hot.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = island.groupBy("island").agg(F.min("at").alias("start"), (F.max("at") + bucket_seconds).alias("end"))
    inside = per.join(F.broadcast(spans), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    by_source = inside.groupBy("start", "end", "source").agg(F.sum("c").alias("c"))
    out = by_source.groupBy("start", "end").agg(F.sum("c").alias("errors"), F.max(F.struct("c", F.col("source"))).alias("top"))
    out = out.select(F.timestamp_seconds("start").alias("start"), F.timestamp_seconds("end").alias("end"), "errors", share_of(F.col("top.c"), F.col("errors")).alias("top_share"))
    out = out.orderBy(F.desc("errors"), "start")
    return out.limit(most) if most else out


def share_of(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole, 4)
