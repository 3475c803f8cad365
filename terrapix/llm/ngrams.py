"""Hashed character n-grams in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
CHUNK_CHARS = 1 << 18


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of points, in order."""
    x = points.astype(np.uint64)
    if len(x) < n:
        return np.zeros(0, np.uint64)
    h = x[: len(x) - n + 1] + np.uint64(n << 32)
    for k in range(1, n):
        h = h * _STEP + x[k : len(x) - n + 1 + k]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def chunks(points: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the sizes, a bounded number at a time."""
    for n in sizes:
        for at in range(0, max(len(points) - n + 1, 0), CHUNK_CHARS):
            yield hashes(points[at : at + CHUNK_CHARS + n - 1], n)
