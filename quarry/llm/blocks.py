"""Sorted hashes as compact blocks, cut at hash ranges."""

from __future__ import annotations

import numpy as np
import zstandard


def planes(values: np.ndarray, size: int) -> bytes:
    """Unsigned values byte plane by byte plane, ``size`` low bytes each: the high planes are mostly zeros
    or of few values, so they compress well."""
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes(), 1)


def unplanes(blob: bytes, size: int) -> np.ndarray:
    found = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, :size] = found.T
    return out.view("<u8").ravel()


def deltas(sorted_values: np.ndarray, low: int, bits: int) -> bytes:
    """Differences of sorted values of ``bits`` bits, the first to ``low``."""
    return planes(np.diff(sorted_values, prepend=np.uint64(low)), bits // 8)


def undeltas(blob: bytes, low: int, bits: int) -> np.ndarray:
    return np.cumsum(unplanes(blob, bits // 8), dtype=np.uint64) + np.uint64(low)


def range_start(part: int, parts: int, bits: int) -> int:
    """Smallest value of range ``part`` when all values of ``bits`` bits are cut in ``parts`` ranges."""
    return -(-(part << bits) // parts)


def cuts(sorted_values: np.ndarray, parts: int, bits: int):
    """(part, from, to) of the ranges that hold values."""
    starts = np.array([range_start(p, parts, bits) for p in range(parts)], np.uint64)
    ends = np.append(np.searchsorted(sorted_values, starts), len(sorted_values)).tolist()
    return [(p, lo, hi) for p, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi]
