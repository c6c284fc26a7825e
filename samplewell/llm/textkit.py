"""Words and word shingles as 64-bit hashes, for the fingerprint and join operators (Python side)."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of a worker's word table; it starts anew beyond that.
WORD_TABLE = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at \\x20 and \\x09-\\x0D: bytes.lower() and bytes.split() do just that."""
    return text.encode().lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the runs of `size` words; with fewer words, the whole sequence as one; none without words."""
    found = words(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, found), np.uint64, n)
    k = min(size, n)
    x = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(x)
