"""Word shingles of whole texts as 64-bit hashes, for code that runs inside tasks."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_KEPT_WORDS = 120_000  # hashes of words kept by one Python worker before it starts anew


class WordHashes(dict):
    """64-bit hash per word, computed once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_hashes = WordHashes()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of ``text``.

    Words are runs of bytes other than space and \\t to \\r, with A-Z lowered (bytes.split and bytes.lower do exactly
    this). Fewer words than ``width`` make one shingle of the whole sequence; no word makes the empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = mix64(out * _PAIR + h[k : len(h) - size + 1 + k])
        out = mix64(out + np.uint64(size))
    return np.unique(out)
