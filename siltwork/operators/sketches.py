"""Opt-in sketches of columns: distinct counts (HyperLogLog) and quantiles (KLL), stored for each part of a table and merged.

A part (a day, a partition) is read once; its sketches are a few kilobytes a column, and any set of parts is answered from
them without a look at the rows. Exact answers (`profile`) are the default elsewhere. Counts, missing values, least and
greatest values are exact. With the defaults, a distinct count is within DISTINCT_ERROR of the exact one and the rank of a
quantile within RANK_ERROR, each in 99 of 100 cases.

Defined cases: nulls are counted as missing and not sketched; a part, or all of them, without a number has a null in place
of quantiles; a null key of parts is a part of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
#: three standard errors of 2^12 registers, and the published error of a KLL sketch with k = 400
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.0085
#: sketches merged by one task at first
FAN_IN = 64


def sketch(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, rows, missing, least, greatest, distinct_sketch, quantile_sketch): a row per part and column."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias("value")) for c in columns])  # no negative zeros
    long = df.select(*[F.col(f"`{c}`") for c in by], F.explode(cells).alias("c")).select(*[F.col(f"`{c}`") for c in by], "c.*")
    v = F.col("value")
    return long.groupBy(*[F.col(f"`{c}`") for c in by], "column").agg(
        F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("least"), F.max(v).alias("greatest"),
        F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), LG_K).alias("distinct_sketch"), F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, KLL_K)).alias("quantile_sketch"),
    )


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts -> those of coarser parts (by), or of the whole table.

    Few sketches at a time are put together first, so that no task holds those of all parts."""
    by = by or []
    salted = sketches.withColumn("__some", F.pmod(F.xxhash64("distinct_sketch", "rows", "least"), F.lit(FAN_IN)))
    return _merged(_merged(salted, [*by, "__some"]), by)


def _merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    all_ = F.filter(F.collect_list("quantile_sketch"), lambda s: s.isNotNull())
    joined = F.when(F.size(all_) > 0, F.aggregate(F.slice(all_, 2, F.greatest(F.size(all_), F.lit(1))), F.element_at(all_, 1), lambda a, b: F.kll_sketch_merge_double(a, b)))
    found = sketches.groupBy(*[F.col(f"`{c}`") for c in by], "column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), joined.alias("quantile_sketch"),
    )
    return found


def told(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """What sketches say: distinct values and quantiles, beside the exact figures they carry."""
    at: list[Column] = [F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p))) for p in probabilities]
    q = F.when(F.col("quantile_sketch").isNotNull(), F.array(*at))
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("distinct_sketch"), "quantiles": q}).drop("distinct_sketch", "quantile_sketch")
