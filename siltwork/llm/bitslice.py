"""Hard negatives by bit-sliced integer products: score intervals that tighten plane by plane.

Components are integers in two's complement, so a vector is a sum of bit-planes, the highest one negative. The product of
an anchor with the planes read so far, and the least and greatest that the planes left can add (the anchor's negative and
positive components times all ones), give an interval of the score. Planes are read most significant first; a candidate
goes as soon as its interval lies below the kth score known or outside the window that is asked for. While most
candidates stand, a plane is one matrix product; the few that stay after that are finished pair by pair. Scores that come
out are exact, as all planes of a pair that stays are read.

`top_in_windows` is that search: for each query the k best rows within each of its score windows, of its own label or of
others. `mine` uses it twice, for the positives of each anchor and then, in windows set by the positives' scores, for the
negatives. Rows are dealt to shards and anchors to blocks; a task meets one shard and one block, both of bounded size, and
gives k rows for each window. Anchors are copied to each shard and rows to each block, as every anchor has to meet every
row; nothing is broadcast, and what is written is the table of quantised vectors and the positives.

Defined cases: rows with a null id, label or vector, or with a component that is null or not finite (256-fold too), take
no part; only vectors of equal length meet, and empty ones score 0; scores beyond the range of a long are cut off there;
ties go to the smaller id; rows that repeat an id are rows of their own, but none of an anchor's own id meets it, and
anchors that repeat id, label and vector count once; an anchor without positives, or a positive without a row in its
window (any with a score below 0), gives no rows; components may be of any size and vectors of any length; an empty table
gives no rows; columns beyond vec_id, embedding and label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.session import cut_lineage

SCALE = 256.0
#: components of a shard and of a block of anchors, at most; rows of a shard, so that there are many tasks
SHARD_CELLS, BLOCK_CELLS, SHARD_ROWS = 1 << 20, 1 << 18, 8192
#: rows whose intervals are held at once
CHUNK = 1024
#: share of candidates below which planes are multiplied pair by pair
SPARSE = 0.02
_LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, embedding, label) -> id, label, x (whole numbers held as doubles), dim; only rows that take part."""
    own = df.select(F.col("vec_id").cast("long").alias("id"), "label", F.transform("embedding", lambda c: whole(c, scale)).alias("x"))
    usable = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & usable).withColumn("dim", F.size("x"))


def whole(c: Column, scale: float) -> Column:
    """floor(scale * c) as a double; F.floor alone gives a long, which large values don't fit."""
    y = F.lit(scale) * c.cast("double")
    return F.when(F.abs(y) < F.lit(float(1 << 52)), F.floor(y).cast("double")).otherwise(y)


@dataclass
class Queries:
    """Vectors with an id and a label each, and score windows (low, high), as many for each."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or Python's where these don't do."""
    if not x.size or np.abs(x).max() < 2.0**52:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


def _merge(held: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(window, score, id) of both, the k best of each window; and which of them are the kth."""
    g, s, i = (np.concatenate(p) for p in zip(held, more))
    order = np.lexsort((i, ~s, g))  # ~s falls as s grows, and has no overflow
    g, s, i = g[order], s[order], i[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    keep = place < k
    return (g[keep], s[keep], i[keep]), place[keep] == k - 1


def top_in_windows(q: Queries, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, window, id, score) of the k best rows of each query within each window, among rows of its label or others."""
    n_q, n_w = q.low.shape
    rows, anchors = _integers(x), _integers(q.x)
    sums = np.abs(anchors).sum(axis=1) if anchors.size else np.zeros(n_q, np.int64)
    bits = max(int(rows.max()), -int(rows.min()), 1).bit_length() + 1 if rows.size else 1
    most = int(sums.max()) if n_q else 0
    plain = rows.dtype == np.int64 and anchors.dtype == np.int64 and most << bits < 1 << 53
    if plain:
        kind = np.float32 if most < 1 << 24 else np.float64  # whole sums of a plane are exact in it
        anchors, number = anchors.astype(kind), np.float64
    else:
        rows, anchors, kind, number = rows.astype(object), anchors.astype(object), object, object
    gain = np.where(anchors > 0, anchors, 0).sum(axis=1).astype(number) if anchors.size else np.zeros(n_q, number)
    loss = np.where(anchors < 0, anchors, 0).sum(axis=1).astype(number) if anchors.size else np.zeros(n_q, number)
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = q.low.astype(np.int64).copy()  # what a score must reach in each window
    ceiling = q.high.max(axis=1)

    for at in range(0, len(rows), CHUNK):
        part, own = rows[at : at + CHUNK], slice(at, at + CHUNK)
        alive = ((labels[own][None, :] == q.labels[:, None]) == same) & (ids[own][None, :] != q.ids[:, None])
        # scores are cut off at the range of a long, so that nothing is beyond the ends of it
        floor = [None if v == _LONG.min else int(v) for v in least.min(axis=1)]
        ceil = [None if v == _LONG.max else int(v) for v in ceiling]
        low = np.array([float("-inf") if v is None else v for v in floor], number)[:, None]
        high = np.array([float("inf") if v is None else v for v in ceil], number)[:, None]
        score = np.zeros(alive.shape, number)
        plane = bits - 1
        while plane >= 0 and alive.sum() > SPARSE * alive.size:
            bit = ((part >> plane) & 1).astype(kind)
            score += (anchors @ bit.T).astype(number) * (-(1 << plane) if plane == bits - 1 else 1 << plane)
            left = (1 << plane) - 1
            alive &= (score + (left * gain)[:, None] >= low) & (score + (left * loss)[:, None] <= high)
            plane -= 1
        r, c = np.nonzero(alive)
        s = score[r, c]
        for j in range(plane, -1, -1):
            bit = (part[c] >> j) & 1
            s = s + (anchors[r] * bit).sum(axis=1).astype(number) * (-(1 << j) if j == bits - 1 else 1 << j)
            left = (1 << j) - 1
            keep = (s + left * gain[r] >= low[r, 0]) & (s + left * loss[r] <= high[r, 0])
            r, c, s = r[keep], c[keep], s[keep]
        exact = s.astype(np.int64) if plain else np.array([min(max(int(v), int(_LONG.min)), int(_LONG.max)) for v in s], np.int64)
        more = []
        for w in range(n_w):
            fits = (exact >= least[r, w]) & (exact <= q.high[r, w])
            more.append((r[fits] * n_w + w, exact[fits], ids[own][c[fits]]))
        held, kth = _merge(held, tuple(np.concatenate(p) for p in zip(*more)), k)
        least.reshape(-1)[held[0][kth]] = held[1][kth]
    g, s, i = held
    return g // n_w, g % n_w, i, s


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


_FOUND = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def _search(anchors: DataFrame, rows: DataFrame, k: int, same: bool, shards: int, blocks: int) -> DataFrame:
    """anchors (id, mark, label, x, dim, block, low, high) against rows (id, label, x, dim, shard) -> anchor, mark, place of
    the window, id, score: the k best of each shard."""

    def one_group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: pd.Series(dtype="int32" if f.name == "place" else "int64") for f in _FOUND})
        width = max(len(v) for v in left["low"])
        low, high = np.full((len(left), width), _LONG.max, np.int64), np.full((len(left), width), _LONG.min, np.int64)
        for n, (a, b) in enumerate(zip(left["low"], left["high"])):
            low[n, : len(a)], high[n, : len(b)] = a, b
        names = pd.factorize(np.concatenate([left["label"].to_numpy(object), right["label"].to_numpy(object)]))[0]
        queries = Queries(left["id"].to_numpy(), names[: len(left)], _matrix(left["x"]), low, high)
        r, w, i, s = top_in_windows(queries, right["id"].to_numpy(), names[len(left) :], _matrix(right["x"]), k, same)
        return pd.DataFrame({"anchor": left["id"].to_numpy()[r], "mark": left["mark"].to_numpy()[r], "place": w.astype(np.int32), "id": i, "score": s})

    to_all = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    of_all = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "shard", "dim"]
    return to_all.groupBy(*keys).cogroup(of_all.groupBy(*keys)).applyInPandas(one_group, _FOUND)


def _share(p: Column, percent: int, up: bool) -> Column:
    """percent / 100 of a long, rounded up or down, within 64 bits."""
    rest = F.pmod(p, F.lit(100).cast("long"))
    hundreds = ((p.cast("decimal(20,0)") - rest.cast("decimal(20,0)")) / 100).cast("long")
    of_rest = (F.ceil if up else F.floor)(rest * percent / 100).cast("long")
    return hundreds * percent + of_rest


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = SCALE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """vectors and anchors (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    positives are an anchor's best rows of its label, negatives the best rows of other labels whose scores lie from low to
    high percent of the positive's.
    """
    usable = quantised(vectors, scale)
    seen = usable.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n, dim = seen["n"], max(1, seen["dim"] or 1)
    shards = max(1, -(-n // min(shard_rows, max(64, SHARD_CELLS // dim))))
    # rows of one id are spread too; the table is written, so that a row stays in its shard
    rows = cut_lineage(usable.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")))
    mark = F.xxhash64("label", "x")
    own = quantised(anchors, scale).withColumn("mark", mark).dropDuplicates(["id", "mark", "label", "x"])
    m = own.count()
    blocks = max(1, -(-m // max(64, BLOCK_CELLS // dim)))
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "mark", F.lit(1)), F.lit(blocks)).cast("int"))

    whole_range = own.withColumn("low", F.array(F.lit(int(_LONG.min)))).withColumn("high", F.array(F.lit(int(_LONG.max))))
    near = _search(whole_range, rows, positives, True, shards, blocks)
    best = F.row_number().over(W.partitionBy("anchor", "mark").orderBy(F.desc("score"), "id"))
    kept = near.withColumn("r", best).filter(F.col("r") <= positives)
    listed = cut_lineage(kept.groupBy("anchor", "mark").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("p")))

    asked = own.join(listed.withColumnRenamed("anchor", "id"), ["id", "mark"])
    windows = asked.withColumn("low", F.transform("p", lambda p: _share(p["score"], low, True))).withColumn("high", F.transform("p", lambda p: _share(p["score"], high, False)))
    far = _search(windows.drop("p"), rows, negatives, False, shards, blocks)
    rank = F.row_number().over(W.partitionBy("anchor", "mark", "place").orderBy(F.desc("score"), "id"))
    told = far.withColumn("rank", rank).filter(F.col("rank") <= negatives).join(listed, ["anchor", "mark"])
    p = F.element_at("p", F.col("place") + 1)
    return told.select(
        F.col("anchor").alias("anchor_id"), p["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )
