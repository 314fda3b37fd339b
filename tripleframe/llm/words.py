"""Words and word shingles of whole texts as hashes, for operators that run in Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from tripleframe.llm.caches import claim, register

CACHE_WORDS = 200_000

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def odd(i: int) -> np.uint64:
    """The i-th of a series of odd multipliers."""
    return np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words that come back; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()
register("words", HASHES.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words (runs of anything but blank, tab, line ends, vertical tab, form feed), A-Z lower-cased."""
    claim("words")
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, no words none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * odd(i)
        total = mix(total + np.uint64(width))
    return np.unique(total)
