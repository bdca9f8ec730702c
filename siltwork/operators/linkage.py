"""Groups of rows that a relation links, from candidate keys, without a list of pairs.

Rows that share a key are candidates. First each row is held against the head of its key, the least row; those linked to
it form a star, and most rows of a group of near copies are settled by that. Only keys whose rows then still stand in more
than one component are compared in full, in cells of two blocks of bounded size, so that a hot key becomes many tasks; a
cell gives each row that is linked to a row of another component one tie, never pairs. The components of stars and ties
are the groups: those of all linked candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.operators.graph import components
from siltwork.session import cut_lineage, free, is_written

#: rows of a block; weight (such as elements of sets) of a block; weight of small keys that are compared in one group
BLOCK, BLOCK_WEIGHT, BUNDLE = 512, 1 << 20, 1 << 16
#: pairs of rows that a task compares at a time
AT_A_TIME = 1 << 22
#: most blocks of a key whose blocks are fine
SPREAD = 8

#: (payload of the left block, payload of the right block) -> boolean matrix
Matrix = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
Similarity = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
#: the same -> parts (i, j) of the pairs that may be linked, none left out that is, and what says of such pairs whether they are
Sieve = Callable[[pd.DataFrame, pd.DataFrame], tuple[Iterator[tuple[np.ndarray, np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]]]


def groups(placed: DataFrame, payload: DataFrame, linked: Callable[[str, str], Column], sieve: Sieve, block: int = 0, fine: int = 0) -> DataFrame:
    """placed (key, id), payload (id, weight, columns to compare) -> (id, label) of rows in groups of two and more.

    linked(a, b) says of two rows, as structs named a and b of the payload's columns, whether they are linked; sieve says
    the same of all pairs of two blocks (of a matrix: sifted). Blocks have so many rows, fine ones while there are few of
    them, so that there is work for many tasks. A payload that is a written table isn't written again, and is freed at the end.
    """
    held, placed = payload if is_written(payload) else cut_lineage(payload), cut_lineage(placed)
    members = cut_lineage(_shared(placed))
    free(placed)
    stars = cut_lineage(_stars(members, held, linked))
    first = cut_lineage(components(stars.select("a", "b")))
    ties = cut_lineage(_ties(members, held, first, sieve, block, fine))
    if ties.isEmpty():
        out = first
    else:
        out = cut_lineage(components(stars.select("a", "b").union(ties.select("a", "b"))))
        free(first)
    free(held, members, stars, ties)
    return out


def pairs(placed: DataFrame, payload: DataFrame, similarity: Similarity, least: float, block: int = 0) -> DataFrame:
    """The same candidates -> (a, b, similarity) of all pairs a < b with that similarity or more, where a list of pairs is
    what is asked for; only such pairs leave the cells."""
    held, placed = payload if is_written(payload) else cut_lineage(payload), cut_lineage(placed)
    rest = _shared(placed).select("key", "id").join(held.select("id", "weight"), "id")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        value = similarity(left, right)
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        i, j = np.nonzero((value >= least) & (x[:, None] != y[None, :]))
        return [(min(a, b), max(a, b), v) for a, b, v in zip(x[i].tolist(), y[j].tolist(), value[i, j].tolist())]

    return _in_cells(rest, held, one, "a long, b long, similarity double", block).distinct()


def _shared(placed: DataFrame) -> DataFrame:
    """(key, id, head) of keys with two rows and more; of keys with the same rows, one."""
    row = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    sizes = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("head"), F.bit_xor(row[0]).alias("x"), F.bit_xor(row[1]).alias("y")).filter("m > 1")
    once = sizes.groupBy("m", "head", "x", "y").agg(F.min("key").alias("key"))
    return placed.join(once.select("key", "head"), "key")


def _stars(members: DataFrame, held: DataFrame, linked: Callable[[str, str], Column]) -> DataFrame:
    """(a, b): heads and the rows linked to them; a row meets a head once, however many keys they share."""
    pairs = members.filter("id <> head").select("head", "id").distinct()
    a = held.select(F.col("id").alias("head"), F.struct("*").alias("a"))
    b = held.select("id", F.struct("*").alias("b"))
    return pairs.join(b, "id").join(a, "head").filter(linked("a", "b")).select(F.col("head").alias("a"), F.col("id").alias("b"))


def _ties(members: DataFrame, held: DataFrame, labels: DataFrame, sieve: Sieve, block: int, fine: int) -> DataFrame:
    """(a, b): ties between rows of different components, from keys whose rows stand in more than one."""
    told = members.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    told = told.join(held.select("id", "weight"), "id")
    still = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return _in_cells(told.join(still, "key"), held, lambda left, right: tie_blocks(left, right, sieve), "a long, b long", block, fine)


def _in_cells(rows: DataFrame, held: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], list[tuple]], schema: str, block: int, fine: int = 0) -> DataFrame:
    """rows (key, id, weight, more) -> what compare says of the pairs of blocks of each key."""
    rows, block = cut_lineage(rows), block or BLOCK
    few = F.least(F.lit(SPREAD), F.ceil(F.count("*") / (fine or block)))
    sizes = rows.groupBy("key").agg(F.greatest(few, F.ceil(F.count("*") / block), F.ceil(F.sum("weight") / BLOCK_WEIGHT)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    every = rows.agg(F.sum("weight")).first()[0] or 0
    # a block meets itself once, and each other block once; small keys are bundled
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    bundle = F.when(F.col("blocks") > 1, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(max(1, every // BUNDLE))))
    cells = cells.withColumn("bundle", bundle).drop("weight", "other", "blocks").join(held.drop("weight"), "id")
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.sort_values(["key", "block", "id"]).groupby("key", sort=False):
            left, right = own[own["block"] == own["lo"].iloc[0]], own[own["block"] == own["hi"].iloc[0]]
            if len(left) and len(right):
                out += compare(left, right)
        return pd.DataFrame(out, columns=names)

    return cells.groupBy("bundle", "lo", "hi").applyInPandas(one, schema)


def sifted(matrix: Matrix) -> Sieve:
    """A matrix as a sieve: its pairs are the linked ones, some rows at a time."""

    def sieve(left: pd.DataFrame, right: pd.DataFrame):
        def parts():
            rows = max(1, AT_A_TIME // len(right))
            for at in range(0, len(left), rows):
                x, y = np.nonzero(matrix(left.iloc[at : at + rows], right))
                yield x + at, y

        return parts(), lambda i, j: np.ones(len(i), bool)

    return sieve


def tie_blocks(left: pd.DataFrame, right: pd.DataFrame, sieve: Sieve) -> list[tuple[int, int]]:
    """Ties that join the components (column label) which links between the rows of two blocks join.

    Pairs are taken in part by part; those of components that are joined by then aren't looked at."""
    la, lb = left["label"].to_numpy(), right["label"].to_numpy()
    if len(la) == 0 or len(lb) == 0 or (la[0] == la).all() and (la[0] == lb).all():
        return []
    names, code = np.unique(np.concatenate([la, lb]), return_inverse=True)
    a, b, least = code[: len(la)], code[len(la) :], np.arange(len(names))  # each component's least name
    parts, check = sieve(left, right)
    for i, j in parts:
        open_ = least[a[i]] != least[b[j]]
        i, j = i[open_], j[open_]
        if len(i):
            hit = check(i, j)
            least = _joined(least, least[a[i[hit]]], least[b[j[hit]]])
    return [(int(names[k]), int(names[v])) for k, v in enumerate(least) if k != v]


def _joined(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """least, where each a and b are joined; they are least ones themselves."""
    if not len(a):
        return least
    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def shared_elements(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right; sets are sorted arrays without repeats.

    Elements of many sets are columns of two 0/1 matrices, those of few are counted pair by pair."""
    same = np.zeros((len(left), len(right)), np.int32)
    sizes = [len(s) for s in left], [len(s) for s in right]
    flat = np.concatenate([*left, *right])
    owner = np.concatenate([np.repeat(np.arange(len(left)), sizes[0]), np.repeat(np.arange(len(right)), sizes[1]) + len(left)])
    order = np.argsort(flat, kind="stable")  # owners of an element ascend: those of the left come first
    flat, owner = flat[order], owner[order]
    if not len(flat):
        return same
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[start, len(flat)])
    n_left = np.add.reduceat(owner < len(left), start)
    pairs = n_left * (count - n_left)
    dense = np.flatnonzero(pairs > 256)
    for at in range(0, len(dense), 1024):
        cols = dense[at : at + 1024]
        a, b = np.zeros((len(left), len(cols)), np.float32), np.zeros((len(right), len(cols)), np.float32)
        for k, c in enumerate(cols):
            own = owner[start[c] : start[c] + count[c]]
            a[own[: n_left[c]], k] = 1
            b[own[n_left[c] :] - len(left), k] = 1
        same += np.rint(a @ b.T).astype(np.int32)
    few = np.flatnonzero((pairs > 0) & (pairs <= 256))
    for at in range(0, len(few), 1 << 14):
        cols = few[at : at + (1 << 14)]
        n, w = pairs[cols], (count - n_left)[cols]
        which = np.repeat(np.arange(len(cols)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i = owner[start[cols][which] + k // w[which]]
        j = owner[(start + n_left)[cols][which] + k % w[which]] - len(left)
        same += np.bincount(i * len(right) + j, minlength=same.size).astype(np.int32).reshape(same.shape)
    return same
