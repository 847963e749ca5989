"""Vectorised words, word hashes and n-gram hashes over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    at = _powers.get(kind)
    if at is None or len(at) < n:
        at = np.full(n, base, np.uint64)
        at[0] = 1
        at = _powers[kind] = np.cumprod(at, dtype=np.uint64)
    return at[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of every row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _NOT_SPACE[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the same word has the same hash everywhere."""
    return span_hashes(prefix_sums(data), starts, ends)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of ``data`` follows."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, max(1, len(data)))[: len(data)], out=prefix[1:])
    return prefix


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * _power("down", _INVERSE, len(prefix))[starts])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for each i; row limits are the caller's."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= _STEP
        h += words[j : j + n]
    return mix(h)


def bounds(doc: np.ndarray, rows: int) -> np.ndarray:
    """rows + 1 limits of each row's words in the flat word order."""
    return np.searchsorted(doc, np.arange(rows + 1))
