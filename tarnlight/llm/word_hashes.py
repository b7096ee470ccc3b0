"""64-bit hashes of the words of a text, for whole arrays of words at once.

A word is a run of bytes other than the space and U+0009 to U+000D. Its hash is a polynomial in an
odd base modulo 2^64, from prefix sums over the text, with its length mixed in. Long texts are
hashed in blocks that end between words, so memory follows the block and the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _ladder(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _grow(size: int) -> None:
    global _powers, _inverses
    if len(_powers) < size:
        size = max(size, 2 * len(_powers))
        _powers, _inverses = _ladder(_BASE, size), _ladder(pow(_BASE, -1, 1 << 64), size)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of an array of bytes."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def _block(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    starts, ends = spans(codes)
    _grow(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(data: bytes) -> Iterator[bytes]:
    """The text in blocks of about BLOCK bytes that end between words; a short text is one block."""
    at = 0
    while at < len(data):
        found = _NEXT_BLANK.search(data, at + BLOCK)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of every word in order; equal words have equal hashes in all texts and runs."""
    if len(data) <= BLOCK:
        return _block(data)
    return np.concatenate([_block(block) for block in blocks(data)])


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of that many words in order; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + n])
    return out
