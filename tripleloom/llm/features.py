"""Hashed n-grams of a text, as numpy arrays of buckets."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of a multiplicative hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def byte_buckets(raw: bytes, bits: int, n: int = 4) -> np.ndarray:
    """Buckets of the n-byte windows (n up to 4); a shorter text is one window, an empty one none."""
    if not raw:
        return np.empty(0, np.uint32)
    a = np.frombuffer(raw.ljust(n), np.uint8).astype(np.uint32)
    m = len(a) - n + 1
    x = a[:m].copy()
    for k in range(1, n):
        x |= a[k : k + m] << np.uint32(8 * k)
    x *= np.uint32(MULTIPLIERS[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MULTIPLIERS[1])
    return x >> np.uint32(32 - bits)


def char_batch(texts: list[str], bits: int, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the buckets of the windows of all texts, one text after the other, and how many each text has.

    They are the rows of a sparse matrix; no window spans two texts.
    """
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    left = np.repeat(np.cumsum(length), length) - np.arange(len(a))  # code points from here to the text's end
    out = []
    for n in sizes:
        m = max(0, len(a) - n + 1)
        x = a[:m] * np.uint32(MULTIPLIERS[0])
        for k in range(1, n):
            x ^= x >> np.uint32(13)
            x += a[k : k + m]
            x *= np.uint32(MULTIPLIERS[k % 4])
        x ^= x >> np.uint32(15)
        x *= np.uint32(MULTIPLIERS[n % 4])
        x >>= np.uint32(32 - bits)
        out.append((x[left[:m] >= n], np.maximum(length - n + 1, 0)))
    return out
