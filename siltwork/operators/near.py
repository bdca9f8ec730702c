"""Near-duplicate groups of texts, images, audio and video.

Each works on rid, the long that orders the rows, and gives groups as (id, label) where label is the least rid. Copies are
collapsed first, candidates share a key, and links are verified exactly; `linkage` makes groups of them without a list of
pairs, however many rows share a key.

Keys of texts are bands of MinHash signatures. Keys of the others are exact: two hashes of 64 bits that differ in d places
agree in one of d + 1 pieces; signatures whose bytes differ by R in sum have sums of bytes, under any signs, that differ by
R at most, so that they share a cell of a grid of such sums, in which each row stands in its own cell and, less than R
below its upper border, in the next one.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions import texts as X
from siltwork.operators import linkage
from siltwork.operators.registry import RID
from siltwork.session import cut_lineage, free

WIDTH, HASHES, BANDS = 3, 64, 16
#: sums of bytes under signs that make the grid, and the width of its cells in radii
SUMS, STEPS = 3, 3
#: signatures are short: their blocks, and those of keys of few blocks, have so many times the rows of others, and rows are
#: copied to fewer blocks
SHORT, FINE = 256, 32
#: most rows of a leaf, whose pairs with those of another leaf are worked out at a time
LEAF = 512


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the distinct runs of lower-case words, sorted; a shorter text is one run."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) > 0, F.sort_array(F.array_distinct(made))).otherwise(F.array().cast("array<bigint>"))

    return X.bound(F.transform(X.words(text), F.lower), runs)


def minhash(sets: Column, hashes: int = HASHES, seed: int = 1) -> Column:
    """Minima of a set of hashes under so many hash functions; empty for an empty set. Those of a batch are worked out at
    once."""
    rng = np.random.default_rng(seed)
    xor, mul = rng.integers(0, 1 << 64, hashes, dtype=np.uint64), rng.integers(0, 1 << 64, hashes, dtype=np.uint64) | np.uint64(1)

    def minima(hashed: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in hashed], np.int64)
        full = np.flatnonzero(sizes)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
        if len(full):
            every = np.concatenate([np.asarray(hashed.iloc[k], np.int64) for k in full]).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            low = np.stack([np.minimum.reduceat((every ^ x) * m, starts) for x, m in zip(xor, mul)], axis=1).view(np.int64)
            for k, row in zip(full, low):
                out[k] = row
        return pd.Series(out, dtype=object)

    return F.pandas_udf(minima, "array<bigint>")(sets)


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y)), lambda e: e))
    return F.when(F.size(a) > 0, same / F.size(a)).otherwise(F.lit(0.0))


def band_keys(signature: Column, bands: int = BANDS, hashes: int = HASHES) -> Column:
    rows = hashes // bands

    def keys(sig: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(sig, b * rows + 1, rows)))
        return F.when(F.size(sig) > 0, made).otherwise(F.array().cast("array<bigint>"))

    return X.bound(signature, keys)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_intersect(a, b))
    return n / (F.size(a) + F.size(b) - n)


def _text_classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (rid, text) -> (id, weight, s) of all, (id) of the first of equal texts, and (a, b) of it and the others.

    Sets are as large as the texts, so they are written once, and only ids and hashes are joined here."""
    every = cut_lineage(docs.select(F.col(RID).alias("id"), shingles(F.col("text"), width).alias("s")).select("id", F.size("s").cast("long").alias("weight"), "s"))
    keyed = cut_lineage(every.filter("weight > 0").select("id", F.xxhash64("s").alias("k"), F.xxhash64(F.lit(1), "s").alias("m")))
    heads = cut_lineage(keyed.groupBy("k", "m").agg(F.min("id").alias("head")))
    copies = cut_lineage(keyed.join(heads, ["k", "m"]).filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    free(keyed)
    return every, heads.select(F.col("head").alias("id")), copies


def _text_keys(every: DataFrame, first: DataFrame) -> DataFrame:
    keys = every.select("id", band_keys(minhash(F.col("s"))).alias("keys"))
    return keys.join(first, "id").select("id", F.explode("keys").alias("key"))


def _text_similarity(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    a, b = left["s"].tolist(), right["s"].tolist()
    same = linkage.shared_elements(a, b)
    return same / (np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - same)


def near_text_pairs(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """docs (rid, text) -> pairs a < b of the first ones of equal texts, with their exact Jaccard similarity."""
    every, first, _ = _text_classes(docs, width)
    return linkage.pairs(_text_keys(every, first), every, _text_similarity, threshold)


def near_text_groups(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """(id, label) of all documents in groups of two and more."""
    every, first, copies = _text_classes(docs, width)
    near = linkage.groups(_text_keys(every, first), every, lambda a, b: jaccard(F.col(f"{a}.s"), F.col(f"{b}.s")) >= threshold, linkage.sifted(lambda x, y: _text_similarity(x, y) >= threshold))
    return with_copies(near, copies)


def with_copies(near: DataFrame, copies: DataFrame) -> DataFrame:
    """Groups (id, label), and copies (a, b) of rows a that may stand in one: the groups of all."""
    of_head = copies.join(near.withColumnRenamed("id", "a"), "a", "left").select("a", "b", F.coalesce("label", "a").alias("label"))
    alone = of_head.filter("a = label").select(F.col("a").alias("id"), "label").distinct()  # heads of groups are their own label
    return near.filter("id <> label").union(of_head.select(F.col("b").alias("id"), "label")).union(alone.union(near.filter("id = label")).distinct())


def _pieces(h: Column, n: int) -> Column:
    """A 64-bit hash in so many pieces, each as one number that tells its place too."""
    edges = [round(64 * k / n) for k in range(n + 1)]
    return F.array(*[F.xxhash64(F.lit(k), F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long"))) for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def hamming_pairs(df: DataFrame, bits: str, max_distance: int) -> DataFrame:
    """Pairs a < b of rid whose 64-bit hashes differ in at most max_distance places.

    By the pigeonhole principle such hashes agree in one of max_distance + 1 pieces; pieces are joined, then counted.
    """
    h = df.select(F.col(RID).alias("id"), F.col(bits).alias("h")).filter("h IS NOT NULL")
    placed = h.select("id", "h", F.explode(_pieces(F.col("h"), max_distance + 1)).alias("piece"))
    x, y = placed.alias("x"), placed.alias("y")
    near = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h"))) <= max_distance
    return x.join(y, (F.col("x.piece") == F.col("y.piece")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def hex_bytes(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c), F.lit(2)), lambda i: F.conv(F.substring(c, i, F.lit(2)), 16, 10).cast("int"))


def hex_distance(a: Column, b: Column) -> Column:
    """Mean difference of the bytes of two hex strings; null where lengths differ."""
    d = F.aggregate(F.zip_with(hex_bytes(a), hex_bytes(b), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), d / (F.length(a) / 2))


def _first_of_equal(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of those with equal values, and ties (a, b) of the first to the others: copies meet no pairs.

    Rows with a null among the values have no signature and take no part."""
    own = df.select(F.col(RID).alias("id"), *columns).na.drop("any", subset=columns)
    first = own.groupBy(*columns).agg(F.min("id").alias("a"))
    copies = own.join(first, columns).filter("a <> id").select("a", F.col("id").alias("b"))
    return first.withColumnRenamed("a", RID), copies


def _bytes(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(bytes.fromhex(x), np.uint8) for x in column]).astype(np.int16)


def _byte_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of differences of the bytes of each row of a and each of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += np.abs(a[:, j][:, None] - b[:, j][None, :])
    return out


def _hash64(c: Column) -> Column:
    """16 hex digits as a long; in halves, as a hash with its highest bit set is beyond a signed one."""
    return F.shiftleft(F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(c, 9, 8), 16, 10).cast("long"))


def near_image_groups(df: DataFrame, max_distance: int = 6, max_thumb: float = 8.0) -> DataFrame:
    """By perceptual hash (16 hex digits in phash) and thumbnail (hex in thumb)."""
    first, copies = _first_of_equal(cut_lineage(df.select(RID, "phash", "thumb")), ["phash", "thumb"])
    own = first.filter((F.length("phash") == 16) & F.unhex("phash").isNotNull() & F.unhex("thumb").isNotNull() & (F.length("thumb") > 0) & (F.length("thumb") % 2 == 0))
    payload = own.select(F.col(RID).alias("id"), F.lit(1).cast("long").alias("weight"), _hash64(F.col("phash")).alias("h"), "thumb")
    # hashes agree in a piece, and thumbnails are as long
    placed = payload.select("id", F.explode(_pieces(F.col("h"), max_distance + 1)).alias("piece"), F.length("thumb").alias("n")).select("id", F.xxhash64("piece", "n").alias("key"))

    def linked(a: str, b: str) -> Column:
        return (F.bit_count(F.col(f"{a}.h").bitwiseXOR(F.col(f"{b}.h"))) <= max_distance) & (hex_distance(F.col(f"{a}.thumb"), F.col(f"{b}.thumb")) <= max_thumb)

    def matrix(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        h = left["h"].to_numpy(np.int64).view(np.uint64)[:, None] ^ right["h"].to_numpy(np.int64).view(np.uint64)[None, :]
        a, b = _bytes(left["thumb"]), _bytes(right["thumb"])
        return (np.bitwise_count(h) <= max_distance) & (_byte_sums(a, b) <= max_thumb * a.shape[1])

    return with_copies(linkage.groups(placed, payload, linked, linkage.sifted(matrix)), copies)


def signature_cells(duration: Column, signature: Column, max_distance: float, tolerance: float) -> Column:
    """Keys, of which two rows share one if their durations differ by the share tolerance at most and their signatures by
    max_distance a byte: length, and cells of log duration and of sums of bytes under signs, each with the cell above if its
    border is within the radius."""

    def keys(d: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for length, raw in zip(d, s):
            b = np.frombuffer(raw, np.uint8).astype(np.int64)
            at = np.arange(len(b))
            radius = max(1.0, max_distance * len(b))
            steps = [(math.log(length) / -math.log(1 - tolerance), 1 + 1e-6)]  # what rounding does to a logarithm
            steps += [(int((b * (1 - 2 * ((at >> k) & 1))).sum() if k >= 0 else b.sum()), radius) for k in range(-1, SUMS - 1)]
            cells = [sorted({math.floor(v / (STEPS * r)), math.floor((v + r) / (STEPS * r))}) for v, r in steps]
            out.append([f"{len(b)}|" + ",".join(map(str, x)) for x in itertools.product(*cells)])
        return pd.Series(out, dtype=object)

    return F.transform(F.pandas_udf(keys, "array<string>")(duration, signature), lambda k: F.xxhash64(k))


def near_audio_groups(df: DataFrame, max_distance: float = 3.0) -> DataFrame:
    return _banded_groups(df, max_distance, 0.02)


def near_video_groups(df: DataFrame, max_distance: float = 6.0) -> DataFrame:
    return _banded_groups(df, max_distance, 0.05)


def _banded_groups(df: DataFrame, max_distance: float, tolerance: float) -> DataFrame:
    """Rows whose durations differ by at most a share, and whose signatures (hex) by max_distance a byte in the mean."""
    fits = (F.col("duration") > 0) & (F.length("signature") > 0) & (F.length("signature") % 2 == 0) & F.unhex("signature").isNotNull()
    # written before it is filtered: else what makes the signatures stands in the filter too, many times
    first, copies = _first_of_equal(cut_lineage(df.select(RID, "duration", "signature")).filter(fits), ["duration", "signature"])
    payload = cut_lineage(first.select(F.col(RID).alias("id"), F.lit(1).cast("long").alias("weight"), F.col("duration").cast("double").alias("d"), F.unhex("signature").alias("s")))
    placed = payload.select("id", F.explode(signature_cells(F.col("d"), F.col("s"), max_distance, tolerance)).alias("key"))

    def linked(a: str, b: str) -> Column:
        x, y = F.col(f"{a}.d"), F.col(f"{b}.d")
        return (F.abs(x - y) <= tolerance * F.greatest(x, y)) & (hex_distance(F.hex(F.col(f"{a}.s")), F.hex(F.col(f"{b}.s"))) <= max_distance)

    def sieve(left: pd.DataFrame, right: pd.DataFrame):
        return signature_sieve(left, right, max_distance, tolerance)

    return with_copies(linkage.groups(placed, payload, linked, sieve, SHORT * linkage.BLOCK, FINE * linkage.BLOCK), copies)


def _leaves(sums: np.ndarray) -> list[np.ndarray]:
    """Rows in leaves, halved where they spread most."""
    out, todo = [], [np.arange(len(sums))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own, half = sums[rows], len(rows) // 2
        order = np.argpartition(own[:, int(np.argmax(own.std(axis=0)))], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def signature_sieve(left: pd.DataFrame, right: pd.DataFrame, max_distance: float, tolerance: float):
    """Pairs of rows (d, s: bytes of one length) that may be within max_distance a byte, and what tells them.

    Rows stand in leaves by the sums of the two halves of their bytes: leaves whose sums are further apart than the radius
    aren't compared. Of two others the squares of the distances of halves are matrix products of whole numbers; a distance
    isn't less than the root of that, so most pairs are settled without their bytes."""
    a, b = (np.frombuffer(b"".join(x["s"]), np.uint8).reshape(len(x), -1).astype(np.int16) for x in (left, right))
    n = a.shape[1]
    radius, kind = max_distance * n + 1e-6, np.float32 if n <= 256 else np.float64  # whole numbers of that size are exact
    same = len(left) == len(right) and bool((left["id"].to_numpy() == right["id"].to_numpy()).all())
    d, e = left["d"].to_numpy(), right["d"].to_numpy()

    def halves(x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : n // 2], x[:, n // 2 :]]

    def factors(x: np.ndarray, first: bool) -> np.ndarray:
        x = x.astype(kind) - 128
        square, one = (x * x).sum(axis=1, dtype=kind)[:, None], np.ones((len(x), 1), kind)
        return np.hstack([x, square, one] if first else [-2 * x, one, square])

    def parts():
        (p, q), sums = ([halves(x) for x in (a, b)]), [np.stack([h.sum(axis=1, dtype=np.int64) for h in halves(x)], axis=1) for x in (a, b)]
        p, q = [factors(x, True) for x in p], [factors(x, False) for x in q]
        rows = [_leaves(s) for s in sums]
        lo, hi = ([np.stack([f(s[x], axis=0) for x in r]) for s, r in zip(sums, rows)] for f in (np.min, np.max))
        for k, i in enumerate(rows[0]):
            gap = np.maximum(np.maximum(lo[0][k] - hi[1], lo[1] - hi[0][k]), 0).sum(axis=1)
            for m in np.flatnonzero(gap <= radius):
                if same and m < k:
                    continue
                j = rows[1][m]
                first, both = p[0][i] @ q[0][j].T, p[1][i] @ q[1][j].T
                both += first
                at = np.flatnonzero(both <= radius * radius)
                first, both = first.ravel()[at], both.ravel()[at]
                at = at[np.sqrt(first) + np.sqrt(both - first) <= radius + 0.01]
                if len(at):
                    yield i[at // len(j)], j[at % len(j)]

    def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, step = np.abs(d[i] - e[j]) <= tolerance * np.maximum(d[i], e[j]), max(1, linkage.AT_A_TIME // n)
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            out[at : at + step] &= np.abs(a[x] - b[y]).sum(axis=1) / n <= max_distance
        return out

    return parts(), check
