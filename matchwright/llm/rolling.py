"""Polynomial hashes of stretches of an array, modulo 2**64, without a loop."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
_letters: dict[tuple[int, int], np.ndarray] = {}


def _table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    size = 1 << size.bit_length()
    if (base, size) not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers[base, size] = both[0], both[1]
    return _powers[base, size]


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> np.uint64(31)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _sums(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _table(base, data.size + 1)
    kinds = 1 << 8 * data.itemsize
    if (base, kinds) not in _letters:
        _letters[base, kinds] = np.random.default_rng(base & 0xFFFF).integers(1, 1 << 63, kinds, dtype=np.uint64)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_letters[base, kinds][data] * up[: data.size], out=sums[1:])
    return sums, down


def window_hashes(data: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` elements."""
    n = data.size
    if n < width:
        return np.empty(0, np.uint64)
    sums, down = _sums(data, base)
    return _mixed((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of every stretch from ``starts`` to ``ends``."""
    sums, down = _sums(data, base)
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
