"""Vectorised words and word shingles of UTF-8 texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from heddle.llm.common import mix64

# The bytes [\x20\x09-\x0D] that part words; A-Z count as a-z.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = 0x9E3779B97F4A7C15
GOLD = np.uint64(ODD)


def salted(i: int) -> np.uint64:
    """The i-th multiple of GOLD modulo 2 ** 64."""
    return np.uint64(i * ODD & (1 << 64) - 1)


@lru_cache
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)[LOWER]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text with the total at the end).

    A word's hash is a polynomial in its bytes, from differences of prefix sums, mixed with its length.
    """
    docs = len(offsets) - 1
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    space = SPACES[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_byte_values()[body] * power[:-1], dtype=np.uint64, out=sums[1:])
    value = (sums[stop] - sums[start]) * inverse[start]
    return mix64(value ^ (stop - start).astype(np.uint64) * GOLD), np.searchsorted(start, offsets)


def shingles(body: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct k-word shingle hashes of each text, where each text's begin).

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    word, first = word_hashes(body, offsets)
    count = np.diff(first)
    parts, owners = [], []
    n = len(word) - k + 1
    if n > 0:
        acc = word[:n].copy()
        for j in range(1, k):
            acc = mix64(acc * GOLD + word[j : j + n])
        doc = np.repeat(np.arange(len(count)), count)
        whole = doc[:n] == doc[k - 1 :]
        parts.append(acc[whole])
        owners.append(doc[:n][whole])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        acc = np.full(len(short), k, np.uint64)
        for j in range(k - 1):
            on = count[short] > j
            acc[on] = mix64(acc[on] * GOLD + word[first[short][on] + j] + np.uint64(1))
        parts.append(acc)
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(count) + 1))
