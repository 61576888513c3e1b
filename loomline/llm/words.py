"""Words and hashes of runs of words of whole texts, for use inside tasks.

A word is a run of characters other than space and U+0009 to U+000D, which is
what bytes.split() gives on UTF-8. Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import xxhash


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _steps(k: int) -> list[tuple[int, int]]:
    """(width, shift) that lead from runs of 1 to runs of k by joining two runs that touch or overlap."""
    out, width = [], 1
    while width < k:
        shift = min(width, k - width)
        out.append((width, shift))
        width += shift
    return out


class Shingles:
    """64-bit hashes of any run of consecutive words of one document: XXH3 of each word, joined pair by pair and mixed each time."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self._words = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, self.n)

    def hashes(self, k: int) -> np.ndarray:
        """One for each of the n - k + 1 runs of k words."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        h = self._words
        for _, shift in _steps(k):
            h = mix(h[:-shift] * np.uint64(0x9E3779B97F4A7C15) + (h[shift:] ^ np.uint64(0xD1342543DE82EF95)))
        return h


def run_numbers(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k numbers, equal if and only if the runs are: pairs are numbered exactly, no hashing."""
    for _, shift in _steps(k):
        if len(numbers) <= shift:
            return np.zeros(0, np.int64)
        pairs = numbers[:-shift] * np.int64(int(numbers.max()) + 1) + numbers[shift:]
        numbers = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    return numbers


def repeated_runs(words: list[bytes], k: int) -> np.ndarray:
    """Whether each run of k words occurs twice or more; words are compared, and hashes only spare texts without repeats."""
    h = np.sort(Shingles(words).hashes(k))
    if not (h[1:] == h[:-1]).any():
        return np.zeros(len(h), bool)
    numbers: dict[bytes, int] = {}
    runs = run_numbers(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), k)
    return np.bincount(runs)[runs] > 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by doubling."""
    for _, shift in _steps(width):
        x = np.minimum(x[:-shift], x[shift:])
    return x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
