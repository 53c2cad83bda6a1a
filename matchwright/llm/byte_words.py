"""Words of whole texts as 64-bit hashes, computed on the bytes of many texts at once.

A text is looked at as UTF-8; separators are ASCII bytes, so no character is ever cut. A
word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, so it
does not depend on where the word stands. ASCII letters count in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at together; texts are put together up to this size, longer ones come alone.
CHUNK = 1 << 21
_WINDOW = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of sequences with one more word each."""
    return mixed(hashes * _STEP + words)


class WordHashes:
    def __init__(self, separators: bytes, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.values[~self.inside] = 0
        self.base = int(rng.integers(1 << 59, 1 << 60)) * 8 + 3
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if self.powers.size < size:
            steps = np.full(max(size, _WINDOW), self.base, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(pow(self.base, -1, 1 << 64))
            self.inverses = np.multiply.accumulate(steps)

    def _windows(self, inside: np.ndarray) -> Iterator[tuple[int, int]]:
        at = 0
        while at < inside.size:
            stop = min(at + _WINDOW, inside.size)
            if stop < inside.size:
                gaps = np.flatnonzero(~inside[at:stop])
                if gaps.size:
                    stop = at + int(gaps[-1]) + 1
                else:  # one word longer than the window
                    while stop < inside.size and inside[stop]:
                        stop += 1
            yield at, stop
            at = stop

    def words(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last one, and hash of each word in order."""
        inside = self.inside[text]
        starts, ends, hashes = [], [], []
        for at, stop in self._windows(inside):
            own = inside[at:stop]
            self._reach(own.size)
            edges = np.diff(np.concatenate(([False], own, [False])).view(np.int8))
            a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            sums = np.zeros(own.size + 1, np.uint64)
            np.cumsum(self.values[text[at:stop]] * self.powers[: own.size], out=sums[1:])
            starts.append(a + at)
            ends.append(b + at)
            hashes.append(mixed((sums[b] - sums[a]) * self.inverses[a]))
        if not starts:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.uint64)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


@lru_cache(maxsize=4)
def word_hashes(separators: bytes, seed: int) -> WordHashes:
    return WordHashes(separators, seed)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from and to, their texts as one array of bytes, and where each row starts in it.

    Rows are joined by a line end; NULL is an empty text.
    """
    texts = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    upto = np.cumsum(sizes)
    at = 0
    while at < sizes.size:
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + CHUNK, "right")))
        joined = b"\n".join(x or b"" for x in texts.slice(at, stop - at).to_pylist()) + b"\n"
        starts = np.concatenate(([0], upto[at : stop - 1] - before)).astype(np.int64)
        yield at, stop, np.frombuffer(joined, np.uint8), starts
        at = stop
