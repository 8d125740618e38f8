"""Words and lines of a batch of texts as numpy arrays of positions and 64-bit hashes.

Words are runs of bytes other than space and 0x09 to 0x0D, which in UTF-8 is what the characters are too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mixed, utf8

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """What range_hashes needs; one more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, whatever stands around them."""
    inverse = powers(len(prefix))[1]
    return mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    data: np.ndarray
    offsets: np.ndarray
    prefix: np.ndarray
    #: of each word: its bytes, its text's number in the batch, its hash
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    #: words of the texts before each text, one more than texts
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many of ``text``, the numbers of texts, or the sums of their weights."""
        return np.bincount(text, weights, self.n)

    def count_bytes(self, chosen: np.ndarray) -> np.ndarray:
        """Per text the chosen of all bytes."""
        before = np.zeros(len(chosen) + 1, np.int64)
        np.cumsum(chosen, out=before[1:])
        return before[self.offsets[1:]] - before[self.offsets[:-1]]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of k words begin that stay within a text, and their hashes."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: len(self.text) - k + 1] == self.text[k - 1 :])
        h = self.hash[at]
        for i in range(1, k):
            h = mixed(h * np.uint64(0x100000001B3) + self.hash[at + i])
        return at, h


def words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0] - 1
    last[edges] = inside[edges]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(last) + 1
    prefix = prefix_hashes(data)
    text = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, prefix, start, end, text, range_hashes(prefix, start, end), first)


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the hash of every line (between line feeds) that has a word."""
    feeds = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], feeds + 1]))
    start = start[start < len(w.data)]
    feeds = np.append(feeds, len(w.data))
    end = np.minimum(feeds[np.searchsorted(feeds, start)], w.offsets[np.searchsorted(w.offsets, start, side="right")])
    held = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[held], end[held]
    return np.searchsorted(w.offsets, start, side="right") - 1, range_hashes(w.prefix, start, end)


def repeated(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether its text has its hash more than once, and whether it isn't the first of these."""
    key = mixed(hashes + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, more = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    more[order[:-1][same]] = True
    return more | again, again
