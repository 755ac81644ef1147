"""MinHash and min-max sketches over shingle hashes in vectorised numpy.

A permutation is ``x -> a * x + b`` modulo 2**32 with odd ``a``, a bijection of 32-bit values.  A min-max
sketch keeps the smallest and the largest value of a set under each permutation, so that one hash
evaluation gives two components; the two agree with probability J each and are negatively correlated,
which lowers the variance of the estimate below that of as many independent minima.
"""

from __future__ import annotations

import numpy as np

from . import _text

#: Shingle values looked at in one step; bounds memory on very long texts.
STEP = 2048


class Permutations:
    """``count`` permutations, fixed by ``seed``."""

    def __init__(self, count: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.count = count
        self.a = (rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
        self.b = rng.integers(0, 2**32, count, dtype=np.uint32)

    def extremes(self, values: np.ndarray, starts: np.ndarray, maxima: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Minimum (and maximum) of each run of 64-bit values; runs without values give 2**32-1 (and 0)."""
        n = len(starts) - 1
        low = np.full((n, self.count), 0xFFFFFFFF, np.uint32)
        high = np.zeros((n, self.count), np.uint32) if maxima else None
        x = (values >> np.uint64(32)).astype(np.uint32)[:, None]
        room = np.empty((STEP, self.count), np.uint32)
        edge = starts.tolist()
        with np.errstate(over="ignore"):
            for k in range(n):
                for lo in range(edge[k], edge[k + 1], STEP):
                    hi = min(lo + STEP, edge[k + 1])
                    out = np.multiply(x[lo:hi], self.a, out=room[: hi - lo])
                    out += self.b
                    np.minimum(low[k], out.min(0), out=low[k])
                    if maxima:
                        np.maximum(high[k], out.max(0), out=high[k])
        return low, high


_BAND = np.array([pow(0xBF58476D1CE4E5B9, k + 1, 2**64) for k in range(64)], np.uint64)


def band_keys(columns: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """64-bit keys of bands of ``rows`` neighbouring components; one column a band."""
    n, width = columns.shape
    bands = width // rows
    cut = columns[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = (_text.mix(cut + np.uint64(1)) * _BAND[:rows]).sum(2, dtype=np.uint64)
        key += _text.mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(salt << 20))
    return _text.mix(key)


def set_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of distinct values, whatever their order."""
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_text.mix(values ^ np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        return _text.mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64))
