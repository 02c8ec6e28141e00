"""Hashed sets of two-word shingles, and MinHash signatures of them, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import ship

ship(__name__)

_CACHE_WORDS = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, emptied when it outgrows its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the width-word windows; fewer words make one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64))
    acc = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        acc = mix(acc) + h[k : len(h) - width + 1 + k]
    return np.unique(mix(acc))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seq = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seq[:n] | np.uint64(1), seq[n:]


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, as uint32."""
    out = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(values), 2048):
        part = values[k : k + 2048, None] * a
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)

