"""Words of UTF-8 bytes as numpy arrays: where they are, and a 64-bit hash of each."""

from __future__ import annotations

import re

import numpy as np

PIECE = 1 << 20
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern: bytes) -> np.ndarray:
    """Which byte values a one-byte class matches."""
    found = re.compile(pattern)
    return np.array([found.fullmatch(bytes([b])) is not None for b in range(256)])


# fixed values: classes of word bytes; bytes from 0x80 on belong to characters outside ASCII
ALNUM = byte_class(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
SPACED = byte_class(rb"[^\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(33)
    x = x * _MIX[1]
    x ^= x >> np.uint64(33)
    return x


def spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): bytes of each word; first[d]:first[d + 1] are the words of text d.

    ``data`` must be lower-cased already. A word never runs over the end of a text.
    """
    inside = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[at] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the work arrays are bounded by PIECE and the longest word."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    power = np.cumprod(np.full(int(lengths.max(initial=1)), _BASE, np.uint64))
    total = np.concatenate(([0], np.cumsum(lengths)))
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + PIECE, "right")) - 1)
        count = lengths[low:high]
        begin = total[low:high] - total[low]
        within = np.arange(total[high] - total[low]) - np.repeat(begin, count)
        letters = data[within + np.repeat(starts[low:high], count)].astype(np.uint64)
        letters += np.uint64(1)
        letters *= power[within]
        out[low:high] = np.add.reduceat(letters, begin)
        low = high
    return mix(out ^ lengths.astype(np.uint64))
