"""Words and hashes of byte ranges for many texts at once, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASES = (_BASE, 0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: bytes) -> np.ndarray:
    """A table that is true for the bytes of words: all but the separators."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


# Letters, digits and everything beyond ASCII / everything but white space.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
NOT_SPACE = byte_class(bytes([0x20, *range(0x09, 0x0E)]))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_values(which: int, fold: bool) -> np.ndarray:
    """A fixed random 64-bit value per byte; with ``fold``, A-Z have those of a-z."""
    values = np.random.default_rng(1000 + which).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    return values[LOWER] if fold else values


# Bytes that are hashed at once; powers up to here are kept, later ones are made from them.
HASH_STEP = 1 << 16


def powers(base: int, size: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, ``size`` of them."""
    found = np.full(size, base, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


@lru_cache(maxsize=8)
def first_powers(base: int) -> np.ndarray:
    """The ``HASH_STEP`` first ones."""
    return powers(base, HASH_STEP)


class RangeHash:
    """64-bit hashes of any byte range of a buffer in constant time, from one running sum.

    Equal ranges have equal hashes wherever they stand, in every buffer and process.  Eight bytes are
    held for a byte of the buffer, the sum, and nothing that lasts.
    """

    def __init__(self, data: np.ndarray, which: int = 0, fold: bool = False):
        base = _BASES[which]
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values, near = byte_values(which, fold), first_powers(base)
        for a in range(0, len(data), HASH_STEP):
            terms = values[data[a : a + HASH_STEP]]
            terms *= near[: len(terms)]
            terms *= np.uint64(pow(base, a, 1 << 64))
            terms[:1] += self.sums[a : a + 1]
            np.cumsum(terms, out=self.sums[a + 1 : a + 1 + len(terms)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = self.sums[ends] - self.sums[starts]
        starts = np.asarray(starts)
        far = powers(pow(self.inverse, HASH_STEP, 1 << 64), len(self.sums) // HASH_STEP + 1)
        found *= first_powers(self.inverse)[starts % HASH_STEP]
        found *= far[starts // HASH_STEP]
        return mixed(found)


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, never across texts, and the number of
    the first word of each text (len + 1 numbers)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)
