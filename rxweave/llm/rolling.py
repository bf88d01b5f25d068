"""Polynomial hashes of any substring of a byte string, modulo 2^64, by prefix sums."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def powers(base: int, n: int) -> np.ndarray:
    values = np.full(n, base, np.uint64)
    values[:1] = 1
    return np.multiply.accumulate(values)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


class Rolling:
    """Hashes of substrings of what was loaded last; tables of powers grow with the longest string seen."""

    def __init__(self, base: int = BASES[0]):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(data) > len(self.powers):
            self.powers, self.inverse = powers(self.base, len(data)), powers(self.back, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def runs(self, width: int) -> np.ndarray:
        """The hash of the width bytes at each place where they fit."""
        n = max(0, len(self.sums) - width)
        return mixed((self.sums[width : width + n] - self.sums[:n]) * self.inverse[:n])
