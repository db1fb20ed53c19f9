"""Vectorised hashes of any byte range: prefix sums of a polynomial modulo 2 ** 64."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_229)
_SETS = 2
#: Random 64-bit values of bytes, for each of two independent hashes.
_VALUES = _rng.integers(1, 1 << 64, (_SETS, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    found = _tables.get(which)
    if found is None or len(found[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[which] = found = both[0], both[1]
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class RangeHash:
    """Hashes of ranges of one byte array; equal bytes give equal hashes in every array."""

    def __init__(self, raw: np.ndarray, which: int = 0) -> None:
        self.power, self.inverse = _powers(which, len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[which][raw] * self.power[: len(raw)], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.prefix) - width)
        return mix((self.prefix[width:][:n] - self.prefix[:n]) * self.inverse[:n] + np.uint64(width))


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hashes of raw[i : i + width] for each start i that has room."""
    return RangeHash(raw).windows(width)
