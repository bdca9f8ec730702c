"""Exact top-k inner products with a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id, queries to blocks; each pair of a block and a shard is one group of
rows. In it a ball tree is built over the shard. Nodes are visited in the order of the upper bound
`query . centre + |query| * radius`; a node is searched only for the queries whose current kth score is not above their
bound, and these kth scores are shared over the whole tree. A first pass over a few vectors gives each block kth scores
to begin with in every shard. Each group gives its k best, and the best of those are the result: no vector is left out.

Sizes: a group holds one shard and one block, both bounded by parameters; queries are copied to each shard, as every
query has to meet every vector; neither side is broadcast.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do rows with a null id;
only vectors of equal length meet; scores are exact integers, computed in doubles where these are exact, else in 64-bit
or longer integers, and cut off at the range of a long; ties go to the smaller id; rows that repeat an id are vectors of
their own, a query meets none of the rows of its own id, and query rows of one id share one ranking; vectors may be long;
an empty table gives no rows; columns beyond vec_id and embedding are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.session import cut_lineage

SCALE = 256.0
LEAF = 128
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
_LONG = np.iinfo(np.int64)


class BallTree:
    """Over the rows of x; children split at the median of the direction of largest spread."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        if len(x):
            self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        part = self.x[rows]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
        me = len(self.nodes)
        self.nodes.append((centre, radius, rows, -1, -1))
        if len(rows) > leaf and radius > 0:
            far = part[((part - centre) ** 2).sum(axis=1).argmax()] - centre
            along = part @ far
            order = np.argpartition(along, len(rows) // 2)
            left = self._build(rows[order[: len(rows) // 2]], leaf)
            right = self._build(rows[order[len(rows) // 2 :]], leaf)
            self.nodes[me] = (centre, radius, None, left, right)
        return me


def _scores(q: np.ndarray, x: np.ndarray, exact_double: bool) -> np.ndarray:
    if exact_double:
        return (q @ x.T).astype(np.int64)
    whole = q.astype(object) @ x.T.astype(object)
    return np.clip(whole, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of the k best of each query, where kth are scores that k others reach."""
    tree = BallTree(x)
    norm = np.sqrt((q**2).sum(axis=1))
    biggest = float(max(np.abs(x).max(initial=0), 1)) * float(max(np.abs(q).max(initial=0), 1)) * x.shape[1]
    plain = biggest < 2**53
    floor = np.full(len(q), _LONG.min, np.int64)
    kth = floor.copy() if kth is None else kth.copy()
    best_s = np.full((len(q), k), _LONG.min, np.int64)
    best_i = np.full((len(q), k), _LONG.max, np.int64)
    have = np.zeros((len(q), k), bool)

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        b = q[active] @ centre + norm[active] * radius
        return b + 1 + 1e-9 * (np.abs(b) + norm[active] * (np.abs(centre).sum() + radius))

    if tree.nodes:
        everyone = np.arange(len(q))
        heap = [(-float(bound(0, everyone).max()), 0, everyone)]
        while heap:
            _, node, active = heapq.heappop(heap)
            b = bound(node, active)
            active = active[b >= kth[active]]
            if not len(active):
                continue
            _, _, rows, left, right = tree.nodes[node]
            if rows is None:
                for child in (left, right):
                    heapq.heappush(heap, (-float(bound(child, active).max()), child, active))
                continue
            s = _scores(q[active], x[rows], plain)
            ok = ids[rows][None, :] != q_ids[active][:, None]
            if len(rows) > 4 * k:  # narrow before sorting; ties at the edge stay in
                cut = np.partition(np.where(ok, s, _LONG.min), len(rows) - k, axis=1)[:, len(rows) - k]
                ok &= s >= np.maximum(cut, kth[active])[:, None]
            hit = np.flatnonzero(ok.any(axis=1))
            for r in hit:
                a = active[r]
                cols = np.flatnonzero(ok[r])
                alls = np.concatenate([best_s[a][have[a]], s[r, cols]])
                alli = np.concatenate([best_i[a][have[a]], ids[rows[cols]]])
                top = np.lexsort((alli, -alls))[:k]
                n = len(top)
                best_s[a, :n], best_i[a, :n], have[a, :n] = alls[top], alli[top], True
                if n == k:
                    kth[a] = max(kth[a], best_s[a, k - 1])
    where = np.nonzero(have)
    return where[0], best_i[where], best_s[where]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, scale: float = SCALE) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite

    def taken(df: DataFrame) -> DataFrame:
        return df.filter(usable).select(F.col("vec_id").cast("long").alias("id"), whole.alias("x"), F.size("embedding").alias("dim"))

    v, q = taken(vectors), taken(queries)
    n, m = v.count(), q.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    # so many groups at least that a cluster has work for all, but no shard below an eighth of the bound
    shards = max(shards, min(24, n // (shard_rows // 8)))
    v = v.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    q = q.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    pair = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def one_group(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in pair.names})
        qi, qx, ids, x = left["id"].to_numpy(), _matrix(left["x"]), right["id"].to_numpy(), _matrix(right["x"])
        kth = left["kth"].to_numpy() if "kth" in left else None
        r, i, s = search(qi, qx, ids, x, k, kth)
        return pd.DataFrame({"query_id": qi[r], "vec_id": i, "score": s})

    def met(qs: DataFrame, vs: DataFrame, keys: list[str]) -> DataFrame:
        return qs.groupBy(*keys).cogroup(vs.groupBy(*keys)).applyInPandas(one_group, pair)

    # scores to begin with: each block against one small shard, the first vectors by another hash
    probe = v.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, n // 1024))) == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    began = met(q.select("block", "dim", "id", "x"), probe.select("block", "dim", "id", "x"), ["block", "dim"])
    kth = began.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
    kth = kth.select(F.col("query_id").alias("id"), "kth")
    q = cut_lineage(q.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(-(2**63)))))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = met(q, v, ["block", "shard", "dim"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
