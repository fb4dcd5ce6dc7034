"""Words and word windows as 64-bit keys, a batch of texts at a time.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, which is exactly what ``bytes.split()`` returns.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

U = np.uint64


class WordKeys(dict):
    """Key of a word, remembered for at most ``limit`` words."""

    limit = 1 << 19

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = key
        return key


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def keyed(texts: list[bytes | None], keys: WordKeys, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts in order, and where each text starts and ends among them."""
    lists = [(t.lower().split() if lower else t.split()) if t else [] for t in texts]
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return np.fromiter(map(keys.__getitem__, chain.from_iterable(lists)), U, int(ends[-1])), ends


#: Odd numbers that window keys are made with; two keys of one window together are as good as one of 128 bits.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def windows(words: np.ndarray, ends: np.ndarray, k: int, factor: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of k words inside one text: its key, the position of its first word, and its text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    key = words[:n].copy()
    for j in range(1, k):
        key *= U(factor)
        key += words[j : n + j]
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    return mix(key[at]), at, of[at]
