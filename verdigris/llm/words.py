"""Words and word sequences as 64-bit hashes, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Words that a task remembers the hashes of before it starts again.
MOST_WORDS = 200_000


class WordHashes(dict):
    """XXH64 of words (bytes) by word; never 0, which marks a break between sequences."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) or 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class BreakHashes(WordHashes):
    """The same, where tokens that begin with one of `breaks` are 0."""

    def __init__(self, breaks: Iterable[int]):
        self.breaks = frozenset(breaks)

    def __missing__(self, word: bytes) -> int:
        if word[0] in self.breaks:
            self[word] = 0
            return 0
        return super().__missing__(word)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """One hash of every window of `size` words, in order."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, (seed + size) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * np.uint64((2 * (seed + j) + 3) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1)
    return mixed(total)
