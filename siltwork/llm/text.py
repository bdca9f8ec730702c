"""Words, word hashes and shingle sets of texts, vectorised in numpy.

Words are runs of ASCII letters and digits and of any character beyond ASCII; A-Z count as a-z. In UTF-8 that is a
mapping of bytes: A-Z to a-z, every other ASCII character but digits and letters to a space.
"""

from __future__ import annotations

import numpy as np

FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def fold(text: str | None) -> bytes:
    """The text as UTF-8 bytes in which words stand between spaces."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD)


def words(text: str | None) -> list[bytes]:
    return fold(text).split()


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, _U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words: starts, and ends (exclusive)."""
    inside = np.zeros(len(folded) + 2, np.int8)
    inside[1:-1] = np.frombuffer(folded, np.uint8) != 32
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(folded: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each word: a polynomial over its bytes, mixed. Long texts go in pieces cut at spaces."""
    out, at, n = [], 0, len(folded)
    while at < n:
        to = n if n - at <= piece else folded.rfind(b" ", at, at + piece)
        if to <= at:
            to = folded.find(b" ", at + 1)
            to = n if to < 0 else to
        part = folded[at:to]
        up, down = _grown(len(part) + 1)
        s, e = word_spans(part)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((np.frombuffer(part, np.uint8).astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        out.append(mixed((sums[e] - sums[s]) * down[s]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of k words in a row; fewer words, but not none, make one shorter shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    total = np.zeros(n - width + 1, _U)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * _U((_BASE * (2 * j + 3) * (2 * j + 3) | 1) & _MASK)
    return np.unique(mixed(total + _U(width)))


class MinHash:
    """The minima of sets under n hash functions, on the upper halves of their shingles."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.mul = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)

    def __call__(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of minima for each of many sets that lie one after the other."""
        high = (shingles >> _U(32)).astype(np.uint32)
        out = np.empty((len(starts), len(self.xor)), np.uint32)
        for k in range(len(self.xor)):
            out[:, k] = np.minimum.reduceat((high ^ self.xor[k]) * self.mul[k], starts)
        return out

    def labels(self, shingles: np.ndarray, starts: np.ndarray, bytes_each: int) -> list[bytes]:
        """The minima of each set one after the other, bytes_each of each, so that labels sort as tries do."""
        low = self(shingles, starts) * np.uint32(0x9E3779B1)
        low ^= low >> np.uint32(15)
        low *= np.uint32(0x85EBCA6B)
        wide = np.ascontiguousarray(low.astype(">u4").view(np.uint8).reshape(*low.shape, 4)[:, :, :bytes_each])
        return [x.tobytes() for x in wide]


def _runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def many_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle sets of many folded texts at once: (shingles, starts, which), where those of text which[k] begin at
    starts[k] and are sorted and distinct. Texts without a word are left out."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    folded = b" ".join(texts)
    hashes = word_hashes(folded, max(1 << 20, len(folded)))
    unit = np.searchsorted(begin, word_spans(folded)[0], side="right") - 1
    count = np.bincount(unit, minlength=len(texts)) if len(unit) else np.zeros(len(texts), np.int64)
    use = count > 0
    found, owner = [], []
    # a text of fewer words than the width is one shorter shingle
    for n in [*np.unique(count[use & (count < width)]).tolist(), width]:
        ok = use[unit] & ((count[unit] >= width) if n == width else (count[unit] == n))
        h, u = hashes[ok], unit[ok]
        m = len(h) - n + 1
        if m <= 0:
            continue
        total = np.zeros(m, _U)
        for j in range(n):
            total += h[j : j + m] * _U((_BASE * (2 * j + 3) * (2 * j + 3) | 1) & _MASK)
        whole = u[:m] == u[n - 1 : n - 1 + m]
        found.append(mixed(total[whole] + _U(n)))
        owner.append(u[:m][whole])
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, u = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((s, u))
    s, u = s[order], u[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (u[1:] != u[:-1])])
    s, u = s[new], u[new]
    starts = _runs(u)
    return s, starts, u[starts]


def many_set_keys(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each of many sets that lie one after the other, as two signed numbers."""
    n = np.diff(np.append(starts, len(shingles))).astype(_U)
    a = np.add.reduceat(mixed(shingles * _U(0xD6E8FEB86659FD93)), starts)
    b = np.add.reduceat(mixed(shingles ^ _U(0xA0761D6478BD642F)), starts)
    return mixed(mixed(a) + n).view(np.int64), mixed(mixed(b) + n).view(np.int64)
