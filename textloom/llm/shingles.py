"""Word hashes and word n-grams of whole texts, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Odd multipliers that mix the places of an n-gram; any odd numbers do.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashed(words: list[bytes]) -> np.ndarray:
    """CRC-32 of each word."""
    return np.fromiter(map(zlib.crc32, words), "<u4", len(words))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each run that is a run of the left followed by one of the right."""
    out = (left ^ (left >> np.uint64(29))) * _MIX + right
    return (out ^ (out >> np.uint64(32))) * _STEP


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of n words; a text of fewer words, but not none, is one run."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    size, rest, length, at, out = len(words) - n + 1, n, 1, 0, None
    power = words.astype(np.uint64)  # numbers of the runs of `length` words, which doubles
    while rest:
        if rest & 1:
            piece = power[at : at + size]
            out, at = piece if out is None else joined(out, piece), at + length
        rest >>= 1
        if rest:
            power, length = joined(power[:-length], power[length:]), 2 * length
    return mixed(out + np.uint64(n))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = np.count_nonzero(np.isin(a, b, assume_unique=True, kind="sort"))
    return both / (len(a) + len(b) - both)
