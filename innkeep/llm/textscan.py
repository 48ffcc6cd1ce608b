"""Words of many texts at once, on UTF-8 bytes with numpy.

All functions take the concatenated bytes of a run of texts and the offsets
of the texts in it."""

from __future__ import annotations

import numpy as np

#: white space of the contracts: space and U+0009 to U+000D (fixed values)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: letters for models: ASCII letters and every byte of a longer UTF-8 sequence
LETTER = np.zeros(256, bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)                       # odd, so invertible modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte range of each maximal run of bytes for which
    ``inside`` holds, never across texts; ``first[i]:first[i+1]`` are text
    i's words."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    yes = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.empty_like(yes)
    prev[0], prev[1:] = False, yes[:-1]
    start = np.flatnonzero(yes & (~prev | edge[:-1]))
    after = np.empty_like(yes)
    after[-1], after[:-1] = False, yes[1:]
    end = np.flatnonzero(yes & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = max(n, 2 * len(self.up))
            up, down = np.full(most, _BASE), np.full(most, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


class RangeHasher:
    """64-bit hashes of byte ranges of one buffer: differences of prefix sums
    of a polynomial modulo 2^64, shifted to a common origin and mixed with the
    length."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return RangeHasher(data)(start, end)


def shingles(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): hashes of every run of ``n`` words in each text; a text
    of fewer words (but not none) has one shingle of them all."""
    counts = np.diff(first)
    n_out = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n_out)]).astype(np.int64)
    if len(word_hash) == 0:
        return np.zeros(0, np.uint64), out_first
    pos = np.arange(out_first[-1]) - np.repeat(out_first[:-1], n_out) + np.repeat(first[:-1], n_out)
    width = np.repeat(np.minimum(counts, n), n_out)
    h = np.zeros(len(pos), np.uint64)
    for j in range(n):
        at = np.minimum(pos + j, len(word_hash) - 1)
        part = word_hash[at] * np.uint64(2 * j + 3) + np.uint64(j + 1)
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.where(width > j, part, np.uint64(0)))
    return h, out_first
