"""Hashes of words and of word windows, whole batches at a time in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_STEP = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def byte_values(seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = _STEP) -> np.ndarray:
    """At least ``n`` powers of an odd number, modulo 2**64."""
    return _powers(max(n, 1).bit_length(), base)


def finish(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def located_words(raw: bytes, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and the bytes at which they start. Words are cut at 0x20 and 0x09-0x0D. Hashes of two seeds are independent."""
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    own = data[~blank]
    place = np.arange(len(own)) - np.repeat(first, sizes)
    mixed = byte_values(seed)[own] * powers(int(sizes.max()), _STEP if seed == 11 else _STEP ^ seed << 8)[place]
    return finish(np.add.reduceat(mixed, first) + sizes.astype(np.uint64)), starts


def word_hashes(raw: bytes, seed: int = 11) -> np.ndarray:
    return located_words(raw, seed)[0]


def joined_words(raws: list[bytes], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, and the text that each is of."""
    hashes, starts = located_words(b"\n".join(raws), seed)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.searchsorted(ends, starts, side="right")


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words; none if there are fewer words. Rolling: the cost doesn't depend on ``n``."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words))[: len(words)], out=sums[1:])
    back = powers(m, pow(_STEP, -1, 1 << 64))[:m]
    return finish((sums[n:] - sums[:m]) * back + np.uint64(n))
