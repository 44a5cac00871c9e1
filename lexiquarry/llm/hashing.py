"""64-bit hashes of words and word shingles, in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from .common import task_cache

CACHE_WORDS = 400_000
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _seen() -> _Hashes:
    return _Hashes()


def forget() -> None:
    _seen().clear()


task_cache(forget)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_seen().__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; empty without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    m = min(n, len(h))
    acc = np.full(len(h) - m + 1, _U(m), dtype=np.uint64)
    for k in range(m):
        acc = mix(acc + h[k : len(h) - m + 1 + k])
    return np.unique(acc)
