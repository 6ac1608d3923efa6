"""Hash order of many keys under many seeds: MD5 of short messages, worked on word by word for all keys at once.

Draws are told apart by a seed before the key, so that seeds change a few words of the message alone and keys are laid out once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

#: Messages that are worked on at once: their words stay in a core's cache.
SLICE = 8192
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_SINES = [int(v) for v in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digested(words: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First three words of the digests of ``n`` messages of one block, whose 16 words are arrays or, if all share them, numbers."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        word = words[_WORDS[i]]
        if isinstance(word, int):
            t += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            t += word
            t += np.uint32(_SINES[i])
        np.left_shift(t, np.uint32(_TURNS[i]), out=u)
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    c += np.uint32(_START[2])
    return a, b, c


def _laid(keys: list[bytes], at: int) -> list:
    """The 16 words of messages of which the keys begin at byte ``at``; bytes before it are 0."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.array(keys, "S")
    block, row = np.zeros((len(keys), 64), np.uint8), np.arange(len(keys))
    block[:, at : at + flat.itemsize] = flat.view(np.uint8).reshape(len(keys), -1)
    block[row, at + size] = 0x80
    bits = 8 * (at + size)
    block[:, 56], block[:, 57] = bits % 256, bits // 256
    words = np.ascontiguousarray(block.view("<u4").T)
    return [int(w[0]) if (w == w[0]).all() else w for w in words]


def leading(keys: list[str], seeds: list[str]) -> np.ndarray:
    """The first eight bytes of the digests of ``seed:key`` as numbers in their order, ``(seed, key)``."""
    return leading_ten(keys, seeds)[0]


def leading_ten(keys: list[str], seeds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`leading`, and the two bytes after these."""
    coded, starts = [k.encode() for k in keys], [f"{s}:".encode() for s in seeds]
    out, more = np.empty((len(starts), len(coded)), np.uint64), np.empty((len(starts), len(coded)), np.uint16)
    if not coded or not starts:
        return out, more
    if max(map(len, coded)) + max(map(len, starts)) > 55:
        for i, s in enumerate(starts):
            digests = [hashlib.md5(s + k).digest() for k in coded]
            out[i], more[i] = [int.from_bytes(d[:8], "big") for d in digests], [int.from_bytes(d[8:10], "big") for d in digests]
        return out, more
    for low in range(0, len(coded), SLICE):
        part = coded[low : low + SLICE]
        for length in sorted({len(s) for s in starts}):
            shared = _laid(part, length)
            for i in (i for i, s in enumerate(starts) if len(s) == length):
                first = np.frombuffer(starts[i] + bytes(-length % 4), "<u4").tolist()
                words = [w + f if isinstance(w, int) else w + np.uint32(f) for w, f in zip(shared, first)] + shared[len(first) :]
                a, b, c = _digested(words, len(part))
                out[i, low : low + len(part)] = np.stack([a, b], 1).astype("<u4").view(">u8")[:, 0]
                more[i, low : low + len(part)] = (c & np.uint32(0xFFFF)).astype("<u2").view(">u2")
    return out, more


def ordered(high: np.ndarray, exact: Callable[[int], np.ndarray]) -> np.ndarray:
    """Places in hash order in each row of ``high``; ``exact(row)`` gives them where the leading bytes leave it open."""
    n = high.shape[1]
    bits = np.uint64(max(n - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort(high & ~low | np.arange(n, dtype=np.uint64), 1)
    order, top = (packed & low).astype(np.int64), packed >> bits
    for i in np.flatnonzero((top[:, 1:] == top[:, :-1]).any(1)):
        order[i] = exact(i)
    return order


def among_first(high: np.ndarray, size: int, exact: Callable[[int], np.ndarray]) -> np.ndarray:
    """Marks the ``size`` places that come first in hash order in each row of ``high``."""
    marks = high <= np.partition(high, size - 1, 1)[:, size - 1 : size] if size else np.zeros(high.shape, bool)
    for i in np.flatnonzero(marks.sum(1) != size):
        marks[i] = False
        marks[i, exact(i)[:size]] = True
    return marks
