"""Arrow-batched text kernel: words, n-grams and lines of many texts at once, as numpy arrays over UTF-8 bytes.

A *word* is a maximal run of ``a-z``, ``0-9`` and non-ASCII characters of the lower-cased text. Words and n-grams are
64-bit hashes: a polynomial prefix hash over the bytes gives the hash of any substring in O(1), so no loop runs in Python.
Texts are taken whole; a chunk holds whole texts, about CHUNK bytes at a time, so memory doesn't grow with a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
MAX_TEXTS = 60_000
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
WORD = np.zeros(256, bool)
WORD[[*range(97, 123), *range(48, 58), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _pow(n: int, kind: str) -> np.ndarray:
    """Powers 0..n-1 of the base, or of its inverse."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + (1 << 18)), _BASE if kind == "base" else _BASE_INV, U)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Chunk:
    """Some whole texts as bytes: text i is data[offs[i]:offs[i + 1]], row first + i of its batch."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1

    def prefix(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * _pow(len(self.data), "base"), out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word; words bounds[i]:bounds[i + 1] are those of text i."""
        data, offs = self.data, self.offs
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(U), np.zeros(self.n + 1, np.int64)
        w = WORD[data]
        heads = offs[:-1][offs[:-1] < len(data)]
        cut = np.zeros(len(data) + 1, bool)
        cut[heads] = True
        cut[-1] = True
        before = np.concatenate(([False], w[:-1])) & ~cut[:-1]
        after = np.concatenate((w[1:], [False])) & ~cut[1:]
        starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        return starts, ends, substrings(self.prefix(), starts, ends), np.searchsorted(starts, offs)


def substrings(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]."""
    return mix((prefix[ends] - prefix[starts]) * _pow(len(prefix), "inverse")[starts] + (ends - starts).astype(U))


def chunks(col: pa.Array, lower: bool = True, most: int = CHUNK) -> Iterator[Chunk]:
    """The texts of an Arrow column, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1), i + MAX_TEXTS, len(col))
        yield Chunk(data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64), i)
        i = j


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a text, and its text. A text of 1 to n-1 words has one n-gram: all its words."""
    lens = np.diff(bounds)
    of = np.repeat(np.arange(len(lens)), lens)

    def fold(parts: list[np.ndarray]) -> np.ndarray:
        g = parts[0]
        for p in parts[1:]:
            g = mix(g * U(0x2545F4914F6CDD1D) + p)
        return g

    if len(h) >= n:
        ok = of[: len(h) - n + 1] == of[n - 1 :]
        g, at = fold([h[k : len(h) - n + 1 + k] for k in range(n)])[ok], of[: len(h) - n + 1][ok]
    else:
        g, at = h[:0], of[:0]
    for m in range(1, n):
        if len(own := np.flatnonzero(lens == m)):
            g = np.concatenate((g, fold([h[bounds[own] + k] for k in range(m)])))
            at = np.concatenate((at, own))
    if n > 1:
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    return g, at


def sets(g: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 47-bit n-grams of each text, and bounds."""
    key = np.sort((at.astype(U) << U(47)) | (g >> U(17)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key & U((1 << 47) - 1), np.searchsorted(key >> U(47), np.arange(n + 1).astype(U))


class Table:
    """Open-addressing map from 64-bit hashes to their positions, looked up a column at a time."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(U)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = U((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at, self.probes = np.arange(len(keys), dtype=np.int32), mix(self.keys) & self.mask, 1
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = left[free][::-1]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + U(1)) & self.mask
            self.probes += bool(len(left))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = mix(h) & self.mask
        out = self.slots[at]
        bad = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        for k in range(1, self.probes):
            if not len(bad):
                break
            cand = self.slots[(at[bad] + U(k)) & self.mask]
            out[bad] = cand
            bad = bad[(cand >= 0) & (self.keys[cand] != h[bad])]
        out[bad] = -1
        return out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; exact for integers."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[bounds[1:]] - total[bounds[:-1]]


def i64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
