"""Approximate nearest neighbours by largest inner product: low-dimensional stable projections under a kd-tree.

A component more, sqrt(M^2 - |x|^2) for rows and 0 for queries scaled to length M, turns the largest inner product into
the least Euclidean distance, with M the largest norm. Vectors are projected onto `axes` Gaussian directions, so that the
squared projected distance over the true one is a chi-square variable of as many degrees. Projected neighbours are
enumerated outwards, in shells of growing radius r, and verified on the whole vectors. With d the distance of the kth best
so far, the search of a query stops once the chi-square distribution at (r / d)^2 reaches `sure`: a row nearer than d lies
farther out with a chance of 1 - sure at most, so that this is the recall at least that is to be expected.

The upper part of the kd-tree is fitted on a bounded sample (`SAMPLE_ROWS` rows of least hash) and has CELLS leaves at
most; every row is put in its cell, and cells go to as many shards as their rows fill, so that a cell of copies is split
as well. First each query meets a few rows, which gives it a kth best score to begin with; then it goes only to the cells
that the stopping radius of that score reaches. Within a shard its own kd-tree, of leaves of LEAF rows with their boxes,
bounds what a shell can hold. The kth scores that come out of the first meeting hold in all shards.

Sizes: a task meets one shard and one block of queries, both bounded by parameters; queries are copied to the cells they
reach and rows to the blocks. To the driver go the sample, the splits and the rows per cell.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part, neither do rows with a
null id; only vectors of equal length meet; scores are sums in double precision, from the first component to the last, of
the original components; ties go to the smaller id; rows that repeat an id are rows of their own, a query meets none of
its own id, and query rows that repeat id and vector count once (those of one id with other vectors share one ranking);
with fewer than k rows known, all rows are verified; vectors may be long; an empty table gives no rows; columns beyond
vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltwork.session import cut_lineage

#: projected dimensions; chance that a row nearer than the kth is within the stopping radius; shells up to that radius
AXES, SURE, SHELLS = 10, 0.97, 4
SAMPLE_ROWS, SAMPLE_CELLS, CELLS = 4096, 1 << 21, 4096
#: rows of a shard, of a block of queries and of a leaf; components of a shard and of a block
SHARD_ROWS, BLOCK_ROWS, LEAF, TASK_CELLS = 8192, 4096, 128, 1 << 20
_LONG = np.iinfo(np.int64)


def chi_square(x: np.ndarray, axes: int) -> np.ndarray:
    """The chi-square distribution function for whole degrees of freedom."""
    h = np.maximum(np.asarray(x, float), 0) / 2
    if axes % 2 == 0:
        term, total = np.exp(-h), np.exp(-h)
        for k in range(1, axes // 2):
            term = term * h / k
            total = total + term
        return 1 - total
    total = np.array([math.erf(v) for v in np.sqrt(h).reshape(-1)]).reshape(h.shape)
    term = np.sqrt(h) * np.exp(-h) / math.gamma(1.5)
    for k in range(1, (axes + 1) // 2):
        total = total - term
        term = term * h / (k + 0.5)
    return total


def chi_square_at(share: float, axes: int) -> float:
    """Where the distribution function reaches a share."""
    low, high = 0.0, 10.0 * axes + 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(chi_square(np.array(mid), axes)) < share else (low, mid)
    return high


def directions(dim: int, axes: int) -> np.ndarray:
    """The same for each length of vectors; the last row is that of the added component."""
    return np.random.default_rng([11, dim, axes]).standard_normal((dim + 1, axes))


def placed(x: np.ndarray, most: float, unit: float, query: bool, axes: int) -> np.ndarray:
    """Projections of rows, or of queries scaled to the largest norm; components are divided by unit first."""
    y = x / unit
    norm2 = (y * y).sum(axis=1)
    if query:
        y = y * (most / np.sqrt(np.maximum(norm2, 1e-300)))[:, None]
        more = np.zeros(len(y))
    else:
        more = np.sqrt(np.maximum(most * most - norm2, 0))
    d = directions(x.shape[1], axes)
    return y @ d[:-1] + more[:, None] * d[-1]


class Splits:
    """The upper part of the tree: halves at the median of the widest axis, down to so many leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis (-1: a leaf, with its number), value, left, right
        self.leaves = 0
        self._build(points, max(0, math.ceil(math.log2(max(1, leaves)))))

    def _build(self, points: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, self.leaves, 0))
        spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(1)
        if depth == 0 or not spread.max() > 0:
            self.leaves += 1
            return me
        axis = int(spread.argmax())
        value = float(np.median(points[:, axis]))
        under = points[:, axis] < value
        if not under.any():
            under = points[:, axis] <= value
            value = float(np.nextafter(value, np.inf))
        left = self._build(points[under], depth - 1)
        right = self._build(points[~under], depth - 1)
        self.nodes[me] = (axis, value, left, right)
        return me

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
                continue
            under = points[rows, axis] < value
            todo += [(left, rows[under]), (right, rows[~under])]
        return out

    def within(self, point: np.ndarray, radius2: float) -> list[int]:
        """Cells whose region comes within the radius of a point."""
        out, todo = [], [(0, 0.0, {})]
        while todo:
            node, far2, off = todo.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                out.append(left)
                continue
            gap = point[axis] - value
            near, away = (left, right) if gap < 0 else (right, left)
            todo.append((near, far2, off))
            beyond = far2 - off.get(axis, 0.0) + gap * gap  # planes of one axis nest, so that the last one counts
            if beyond <= radius2:
                todo.append((away, beyond, off | {axis: gap * gap}))
        return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        own = points[rows]
        spread = own.max(axis=0) - own.min(axis=0)
        if len(rows) <= LEAF or not spread.max() > 0:
            out += [rows[at : at + LEAF] for at in range(0, len(rows), LEAF)]
            continue
        order = np.argpartition(own[:, spread.argmax()], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, kth: np.ndarray, most: float, unit: float, axes: int = AXES, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest found of each query; kth are scores that k rows are known to reach, or -inf."""
    at_q, at_x = placed(q, most, unit, True, axes), placed(x, most, unit, False, axes)
    leaves = _leaves(at_x)
    bound = np.zeros((len(q), len(leaves)))
    for n, rows in enumerate(leaves):
        low, high = at_x[rows].min(axis=0), at_x[rows].max(axis=0)
        bound[:, n] = (np.maximum(np.maximum(low - at_q, at_q - high), 0) ** 2).sum(axis=1)
    widest = chi_square_at(sure, axes)
    norm = np.sqrt(((q / unit) ** 2).sum(axis=1))
    slack = 1e-12 * x.shape[1] * np.sqrt((q * q).sum(axis=1)) * most * unit  # matrix products sum in another order
    kth = kth.copy()
    g, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def stop() -> np.ndarray:
        """The squared radius at which the test holds, with the kth score known."""
        distance2 = 2 * most * most - 2 * most * (kth / unit / unit) / norm
        return np.where(np.isfinite(kth), np.maximum(distance2, 0) * widest * (1 + 1e-9), np.inf)

    inside = np.full(len(q), -1.0)
    for shell in range(1, SHELLS + 1):
        outer = stop() * (shell / SHELLS) ** 2
        found = []
        for n, rows in enumerate(leaves):
            a = np.flatnonzero((bound[:, n] <= outer) & (outer > inside))
            if not len(a):
                continue
            far = at_q[a]
            far = (far * far).sum(axis=1)[:, None] + (at_x[rows] ** 2).sum(axis=1)[None, :] - 2 * far @ at_x[rows].T
            far = np.maximum(far, 0)
            new = (far > inside[a][:, None]) & (far <= outer[a][:, None]) & (ids[rows][None, :] != q_ids[a][:, None])
            score = q[a] @ x[rows].T
            if len(rows) >= k:  # k rows of one leaf may already raise what is to be reached
                kth[a] = np.maximum(kth[a], np.partition(np.where(new, score, -np.inf), len(rows) - k, axis=1)[:, len(rows) - k] - slack[a])
            with np.errstate(invalid="ignore"):
                new &= ~(score < (kth[a] - slack[a])[:, None])
            r, c = np.nonzero(new)
            if len(r):
                found.append((a[r], rows[c]))
        inside = np.maximum(inside, outer)
        if found:
            r, c = (np.concatenate(p) for p in zip(*found))
            exact = np.concatenate([_products(q[r[at : at + 65536]], x[c[at : at + 65536]]) for at in range(0, len(r), 65536)])
            g, i, s = np.r_[g, r], np.r_[i, c], np.r_[s, exact]
            order = np.lexsort((ids[i], -s, g))
            g, i, s = g[order], i[order], s[order]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
            kth[g[place == k - 1]] = np.maximum(kth[g[place == k - 1]], s[place == k - 1])
            g, i, s = g[place < k], i[place < k], s[place < k]
    return g, i, s


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, axes: int = AXES, sure: float = SURE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    nonzero = F.exists("embedding", lambda c: c != 0)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero

    def taken(df: DataFrame) -> DataFrame:
        return df.filter(usable).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("dim"))

    v, q = taken(vectors), taken(queries).dropDuplicates(["id", "x"])
    seen = v.agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("unit")).first()
    n, dim, unit = seen["n"], max(1, seen["dim"] or 1), seen["unit"] or 1.0
    scaled = F.aggregate("x", F.lit(0.0), lambda s, c: s + (c / F.lit(unit)) * (c / F.lit(unit)))
    both = v.select(scaled.alias("s")).agg(F.max("s")).first()[0]
    most = math.sqrt(both or 1.0) * (1 + 1e-9)
    m = q.count()
    rows_of = max(64, min(shard_rows, TASK_CELLS // dim))
    block_of = max(64, min(block_rows, TASK_CELLS // dim))
    blocks = max(1, -(-m // block_of))

    # the upper tree, from the rows of least hash
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // dim))
    share = (wanted + 6 * wanted**0.5 + 50) / max(1, n)
    hashed = v.withColumn("h", F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)))
    sample = hashed.filter(F.col("h") < int(min(1.0, share) * (1 << 30))).orderBy("h", "id").limit(wanted).select("x").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["x"]), []).append(r["x"])
    points = [placed(np.array(p, float), most, unit, False, axes) for p in by_dim.values()]
    leaves = min(CELLS, max(1, len(sample) // 16), max(1, -(-n // rows_of)))
    splits = Splits(np.concatenate(points) if points else np.zeros((0, axes)), leaves)

    def into_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), np.int32)
            for d in b["dim"].unique():
                own = np.flatnonzero(b["dim"].to_numpy() == d)
                cell[own] = splits.cell(placed(_matrix(b["x"].iloc[own]), most, unit, False, axes))
            yield b.assign(cell=cell)

    with_row = v.withColumn("row", F.monotonically_increasing_id())
    cells = cut_lineage(with_row.mapInPandas(into_cells, T.StructType([*with_row.schema.fields, T.StructField("cell", T.IntegerType())])))
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    parts = F.create_map(*[F.lit(c) for cell in sorted(counts) for c in (cell, max(1, -(-counts[cell] // rows_of)))]) if counts else F.lit(None).cast("map<int,int>")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce(parts[F.col("cell")], F.lit(1))).cast("int"))
    q = q.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))

    def one_group(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: pd.Series(dtype="float64" if f.name == "score" else "int64") for f in _FOUND})
        kth, ids = left["kth"].to_numpy(np.float64), right["id"].to_numpy()
        g, i, s = search(left["id"].to_numpy(), _matrix(left["x"]), ids, _matrix(right["x"]), k, kth, most, unit, axes, sure)
        return pd.DataFrame({"query_id": left["id"].to_numpy()[g], "row": right["row"].to_numpy()[i], "vec_id": ids[i], "score": s})

    def met(qs: DataFrame, vs: DataFrame, keys: list[str]) -> DataFrame:
        return qs.groupBy(*keys).cogroup(vs.groupBy(*keys)).applyInPandas(one_group, _FOUND)

    # scores to begin with: each block against one small set of rows
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    few = cells.filter(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(max(1, n // 2048))) == 0).select("dim", "row", "id", "x").withColumn("block", every_block)
    began = cut_lineage(met(q.withColumn("kth", F.lit(float("-inf"))), few, ["block", "dim"]))
    kth = began.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "kth")
    q = q.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    widest = chi_square_at(sure, axes) * (1 + 1e-9)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d in b["dim"].unique():
                own = np.flatnonzero(b["dim"].to_numpy() == d)
                x = _matrix(b["x"].iloc[own])
                at, norm = placed(x, most, unit, True, axes), np.sqrt(((x / unit) ** 2).sum(axis=1))
                for n_, row in enumerate(own):
                    known = b["kth"].iloc[row]
                    radius2 = max(0.0, 2 * most * most - 2 * most * (known / unit / unit) / norm[n_]) * widest if np.isfinite(known) else math.inf
                    out += [(row, c) for c in splits.within(at[n_], radius2) if c in counts]
            rows, into = ([p[0] for p in out], [p[1] for p in out]) if out else ([], [])
            yield b.iloc[rows].assign(cell=np.array(into, np.int32))

    reach = cut_lineage(q.mapInPandas(to_cells, T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType())])))
    reach = reach.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(parts[F.col("cell")], F.lit(1)) - 1)))
    found = met(reach, cells.withColumn("block", every_block), ["block", "cell", "part", "dim"]).union(began).distinct()  # those met first count too
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
