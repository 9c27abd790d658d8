"""Hashes of substrings in numpy: any number of substrings of a text after one pass over its bytes."""

from __future__ import annotations

import numpy as np

from .encode import worker_state

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
FIRST_POWERS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the 256 bytes, and the first ``n`` powers of the base and of its inverse."""
    kept = worker_state()
    known = getattr(kept, "powers", None)
    if known is None or len(known[1]) < n:
        size = FIRST_POWERS
        while size < n:
            size *= 2
        values = mix(np.arange(1, 257, dtype=np.uint64))
        tables = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        known = kept.powers = (values, *tables)
    return known[0], known[1][:n], known[2][:n]


class Substrings:
    """Hashes of substrings of ``data``; equal substrings of any texts have equal hashes."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        values, up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(np.uint64)
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + size)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))
