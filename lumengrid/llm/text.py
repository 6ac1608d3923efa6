"""Word hashing for the numpy parts of the operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the rolling combination of word hashes, and of the final mix.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits; one to one."""
    x = (x ^ (x >> SHIFT)) * MIX
    x = (x ^ (x >> SHIFT)) * MIX
    return x ^ (x >> SHIFT)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, by start; empty where there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    out = words[:n].copy()
    for j in range(1, k):
        out = out * STEP + words[j : j + n]
    return mix(out)
