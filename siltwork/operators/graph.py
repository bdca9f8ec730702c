"""Connected components of an edge table by large-star and small-star steps, on long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.session import cut_lineage, free

MOST_ROUNDS = 60
#: with so many edges or fewer, tables of minima (a row of two numbers per id) are broadcast
FEW_EDGES = 1 << 19


def components(edges: DataFrame, few: int = FEW_EDGES, most: int | None = None) -> DataFrame:
    """edges (a, b) -> (id, label) for all ids in them; label is the least id of the component.

    An edge is held once, as (u, v) with u > v. A round moves v to the least neighbour of v (large star), then all
    smaller neighbours of u, and u, onto the least of them (small star). The minima come from partial aggregation; they
    are broadcast while edges are few, else written, so that the joins with them are plain ones and the many edges of a
    hub are split among tasks. There are at most `most` edges, if that is known. It ends with a round that changes nothing; then each id has one edge, to a root.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), most)
    n = e.count()
    small = n <= few
    written: list[DataFrame] = []

    def minima(df: DataFrame) -> DataFrame:
        if small:
            return F.broadcast(df)
        written.append(cut_lineage(df, 2 * n))
        return written[-1]

    for _ in range(MOST_ROUNDS):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        moved = e.select("u", "v").join(low, "v").groupBy("u", "m").agg(F.max(F.col("m") < F.col("v")).alias("moved"))
        star = moved.select("u", F.col("m").alias("v"), "moved")
        if not small:  # few edges are joined again sooner than written and read
            star = cut_lineage(star, n)
        least = minima(star.groupBy("u").agg(F.min("v").alias("m")))
        # an edge that is the least of its id stays, any other joins its smaller end to the least
        moved = star.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), "m", (F.col("moved") | (F.col("v") > F.col("m"))).alias("moved"))
        after = cut_lineage(moved.groupBy("u", F.col("m").alias("v")).agg(F.max("moved").alias("moved")), n)
        free(e, star, *written)
        written.clear()
        e = after
        if not e.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
