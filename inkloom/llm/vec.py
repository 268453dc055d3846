"""Vectorised text primitives: whole Arrow batches of text as flat NumPy arrays of code points."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of all texts and the offsets at which each text begins (one more at the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return flat, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def rolling_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n code points; entry i belongs to flat[i:i+n]."""
    m = len(flat) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h *= _MUL
        h += flat[i : i + m]
    return mix(h)


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, flat, and their offsets.

    A text shorter than n has itself as its only gram, an empty text none.
    """
    flat, offsets = code_points(texts)
    hashes = rolling_hashes(flat, n)
    parts, sizes = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1]
        if b - a >= n:
            s = hashes[a : b - n + 1].copy()
            s.sort()
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = rolling_hashes(flat[a:b], int(b - a))
        else:
            s = hashes[:0]
        parts.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def slices(batches, column: str, most: int = 1 << 21):
    """Parts of the record batches with at most so many characters in ``column`` each (one row at least).

    Bounds the memory of array work to the longest text plus ``most`` characters.
    """
    for batch in batches:
        sizes = np.array([len(t) if t else 0 for t in batch.column(column).to_pylist()], dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
