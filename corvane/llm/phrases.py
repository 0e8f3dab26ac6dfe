"""Phrases of texts: places where a rolling hash sets a trigger, found on whole buffers of bytes."""

from __future__ import annotations

import numpy as np

GRAM = 32
_RNG = np.random.default_rng(100)
_VALUES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POS_BITS = 23
#: Bytes that a buffer may hold.
MAX_BUFFER = 1 << _POS_BITS


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Hashes:
    """Hash of any stretch of a buffer, from sums of values times powers (modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), out=self.sums[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of v[i : i + width] for each i where they are all there."""
    p = 1
    while 2 * p <= width:
        v = np.minimum(v[:-p], v[p:])
        p *= 2
    return np.minimum(v[: len(v) - (width - p)], v[width - p :]) if width > p else v


def parse(data: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Phrases of the texts that lie in data one after the other, text i up to ends[i].

    A string of length bytes has its trigger at the least hash of its GRAM-byte stretches (the leftmost of equals),
    so equal strings have it at the same place. A phrase is a run of strings with one trigger: doc (number of
    the text), start (of the first string, in data), n (strings), anchor and phrase (hashes of the trigger and of
    the bytes that the strings cover).
    """
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "n", "anchor", "phrase")}
    hashes = Hashes(data)
    grams = hashes.grams(GRAM)
    low = np.uint64(MAX_BUFFER - 1)
    trigger = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    sizes = np.diff(np.concatenate([[0], ends]))
    doc = np.repeat(np.arange(len(ends)), sizes)[: len(trigger)]
    valid = np.arange(len(trigger)) + length <= ends[doc]
    first = valid.copy()
    first[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    below = np.concatenate([[0], np.cumsum(valid)])
    n = np.diff(np.concatenate([below[start], below[-1:]]))
    at = trigger[start]
    return {"doc": doc[start], "start": start, "n": n, "anchor": grams[at].view(np.int64), "phrase": hashes.of(start, start + n + length - 1).view(np.int64)}
