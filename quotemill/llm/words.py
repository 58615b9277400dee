"""Words as arrays of hashes, for the operators that walk texts in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_BREAKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_BLANK = bytes(32 if b in _BREAKS else b for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lowered, then the runs of characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return text.encode().lower().translate(_TO_BLANK).split() if text else []


class WordHashes(dict):
    """64-bit hash by word; emptied when it has grown large, which changes no result."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` values, by their start."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + values[j : j + n]
    return mix(out)


def window_minima(values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of each run of ``w``, and the place of its last occurrence in the run."""
    n = len(values) - w + 1
    least, at = values[w - 1 : w - 1 + n].copy(), np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        here = values[j : j + n]
        less = here < least
        least[less] = here[less]
        at[less] = np.nonzero(less)[0] + j
    return least, at
