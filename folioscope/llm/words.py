"""64-bit hashes of words, taken on whole arrays of bytes."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BYTE = mix(np.arange(1, 257))
_powers = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and where it begins, words parted by ASCII white space."""
    global _powers
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts = edge[::2]
    sizes = edge[1::2] - starts
    if not len(sizes):
        return np.empty(0, np.uint64), starts
    first = np.cumsum(sizes) - sizes
    chars = data[inside]
    if (longest := int(sizes.max())) > len(_powers):
        _powers = np.cumprod(np.full(2 * longest, 0x100000001B3, np.uint64))
    return mix(np.add.reduceat(BYTE[chars] * _powers[np.arange(len(chars)) - np.repeat(first, sizes)], first)), starts


def word_hashes(text: str) -> np.ndarray:
    """Of a text, A-Z lowered."""
    return hashed_words(np.frombuffer(text.encode().lower(), np.uint8))[0]
