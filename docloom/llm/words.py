"""Hashes of a text's words and word runs."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from .common import worker_cache

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs without ASCII white space) of a text begin and end."""
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The XXH3 hash of each word."""
    worker_cache("words", dict)  # other operators' tables go
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` consecutive words (none if there are fewer)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    multiplier = np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
    out = words[:n].copy()
    for k in range(1, length):
        out = (out ^ (out >> np.uint64(29))) * multiplier + words[k : k + n]
    return mix(out ^ np.uint64(seed))
