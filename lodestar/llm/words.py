"""Words of a text and their 64-bit hashes, vectorised per Arrow batch.

A word is a maximal run of Unicode letters and digits, lower-cased; everything else separates.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_CAPACITY = 1_000_000


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "İ" in text:  # lower-casing it first would split the run
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(self) >= _CAPACITY:
            self.clear()
        self[word] = h
        return h


HASHES = WordHashes()


def hash_words(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _M1 + h[k : len(h) - n + 1 + k])
    return out
