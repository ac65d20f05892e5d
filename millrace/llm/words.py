"""Words of whole Arrow text columns as numpy arrays: places, owners and 64-bit hashes, without a Python loop.

A word class is a table of 256 flags over UTF-8 bytes.  Both classes in use (``ALNUM`` and ``NONSPACE``)
are defined by ASCII characters only and hold every byte from 0x80 on, so they agree with the same
class over code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.common import large_text

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, bool)
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums s with: span_hash(s, a, b) depends only on values[a:b]."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[b] - prefix[a]) * down[a])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


class Words:
    """The words of a text column.

    data: the bytes, A-Z in lower case; bounds: where each text begins in data (n + 1);
    start, end: a word's bytes; first: each text's first word (n + 1); hash: a word's hash.
    """

    def __init__(self, column: pa.Array, keep: np.ndarray = ALNUM, hashed: bool = True):
        arr = large_text(column)
        offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
        buffer = arr.buffers()[2] if len(arr) else None
        raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.data = _LOWER[raw]
        n = len(raw)
        inside = keep[self.data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        cuts = self.bounds[:-1][self.bounds[:-1] < n]
        head[cuts] = inside[cuts]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        cuts = self.bounds[1:][self.bounds[1:] > 0] - 1
        tail[cuts] = inside[cuts]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        if hashed:
            self.hash = span_hash(prefix_hash(byte_values(self.data)), self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie within one text."""
        n = len(self)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            m = n - k + 1
            g = np.zeros(m, np.uint64)
            for j in range(k):
                g = g * np.uint64(_BASE) + self.hash[j : j + m]
            out[:m] = mix(g)
            last = np.repeat(self.first[1:], self.counts())
            ok[:m] = np.arange(m) + k <= last[:m]
        return out, ok


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w consecutive values; len(a) - w + 1 values."""
    have = 1
    while have * 2 <= w:
        a = op(a[: len(a) - have], a[have:])
        have *= 2
    return op(a[: len(a) - (w - have)], a[w - have :]) if w > have else a
