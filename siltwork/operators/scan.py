"""Running sums over ordered rows of files, however large: ranges are summed apart and shifted by what lies before them.

The order is (by..., order): rows are dealt to ranges of it, so that one large file fills many tasks and a task may hold the
end of one file and the start of the next. What is carried over a border is one number for each range and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.session import cut_lineage

_PART = "__range"


def in_ranges(df: DataFrame, by: list[str], order: list[str], parts: int = 0) -> DataFrame:
    """df in ranges of the order, numbered; written, so that ranges stay as they are."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *by, *order).withColumn(_PART, F.spark_partition_id()))


def running_sum(df: DataFrame, amount: Column, name: str, order: list[str], by: list[str] | None = None, parts: int = 0) -> DataFrame:
    """df and name: the sum of amount over this row and those before it among the rows of equal by, in the given order.

    Rows of one order keep to one range, and count as one after the other there.
    """
    by = by or []
    held = in_ranges(df.withColumn(name, amount.cast("long")), by, order, parts)
    sums = held.groupBy(_PART, *by).agg(F.sum(name).alias("__sum"))
    before = W.partitionBy(*by).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)  # a row for each range and file
    shift = sums.select(_PART, *by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    inner = F.sum(name).over(W.partitionBy(_PART, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    left, right = held.withColumn(name, inner).alias("l"), shift.alias("r")
    same = F.col(f"l.{_PART}") == F.col(f"r.{_PART}")
    for c in by:
        same &= F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.join(right, same).select(*[F.col(f"l.`{c}`") for c in df.columns if c != name], (F.col(f"l.`{name}`") + F.col("r.__shift")).alias(name))


def running_state(df: DataFrame, from_out: Column, from_in: Column, name: str, order: list[str], by: list[str] | None = None, parts: int = 0) -> DataFrame:
    """df and name: the state (0 or 1) before each row, 0 at the start of each file, where a row takes state 0 to from_out
    and state 1 to from_in.

    A row either sets the state, keeps it or turns it over; what a range of rows does to a state follows from the last row
    that sets it and the number of turns since, so that ranges are scanned apart and only their effects are put in order.
    """
    by = by or []
    sets = F.when(F.col("__a") == F.col("__b"), F.col("__a"))
    turns = ((F.col("__a") == 1) & (F.col("__b") == 0)).cast("int")
    held = in_ranges(df.withColumn("__a", from_out.cast("int")).withColumn("__b", from_in.cast("int")), by, order, parts)

    def effects(rows: DataFrame, upto: int, groups: list[str], ordered: list[str]) -> DataFrame:
        """__turn and __set: the turns of the rows before (or with) this one, and the last state set, as it was before them."""
        w = W.partitionBy(*groups).orderBy(*ordered).rowsBetween(W.unboundedPreceding, upto)
        rows = rows.withColumn("__upto", F.sum(turns).over(W.partitionBy(*groups).orderBy(*ordered).rowsBetween(W.unboundedPreceding, 0)) % 2)
        rows = rows.withColumn("__turn", F.coalesce(F.sum(turns).over(w), F.lit(0)) % 2)
        return rows.withColumn("__set", F.last(sets.bitwiseXOR(F.col("__upto").cast("int")), ignorenulls=True).over(w))

    inside = effects(held, -1, [_PART, *by], order)
    ends = effects(held, 0, [_PART, *by], order)
    # each range as one row that takes 0 to __a and 1 to __b
    last = ends.groupBy(_PART, *by).agg(F.max_by(F.struct("__turn", "__set"), F.struct(*order)).alias("e"))
    after = lambda start: F.coalesce(F.col("e.__set"), F.lit(start)).bitwiseXOR(F.col("e.__turn").cast("int"))
    starts = effects(last.select(_PART, *by, after(0).alias("__a"), after(1).alias("__b")), -1, by, [_PART])
    starts = starts.select(_PART, *by, F.coalesce("__set", F.lit(0)).bitwiseXOR(F.col("__turn").cast("int")).alias("__start"))
    same = F.col(f"l.{_PART}") == F.col(f"r.{_PART}")
    for c in by:
        same &= F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    state = F.coalesce(F.col("l.__set"), F.col("r.__start")).bitwiseXOR(F.col("l.__turn").cast("int"))
    return inside.alias("l").join(starts.alias("r"), same).select(*[F.col(f"l.`{c}`") for c in df.columns], state.alias(name))
