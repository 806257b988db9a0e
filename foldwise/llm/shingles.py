"""Sets of word shingles as sorted 64-bit hashes, and the global token order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .text import mix, word_hashes

CELLS = 1 << 22


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, size: int) -> Iterator[np.ndarray]:
    """For each of the texts i..j-1 its distinct shingles of ``size`` words,
    sorted; a shorter text is one shingle, one without words has none."""
    _, _, _, words, first = word_hashes(raw, offsets, i, j)
    n = len(words) - size + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = np.full(n, np.uint64(size))
        for k in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k:n + k]
        rolled = mix(rolled)
    for r in range(j - i):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= size:
            yield np.unique(rolled[a:b - size + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w
            yield mix(np.array([h]))
        else:
            yield np.zeros(0, np.uint64)


def set_hash(tokens: np.ndarray) -> int:
    """64-bit hash of a set (as a signed value): equal sets have equal hashes.
    The tokens are hashes themselves, so their sum is as good as random."""
    h = (int(np.sum(tokens, dtype=np.uint64)) + len(tokens)) * 0x9E3779B97F4A7C15 % 2**64
    return h - 2**64 if h >= 2**63 else h


def prefix(tokens: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set in the global order (by level, then hash), and
    for each the size of the largest set with which it can be the first shared
    one of ``percent`` similar sets: beyond that too few tokens are left here.
    The first token that two similar sets share is in both answers, and the
    reach of each is the other's size at least."""
    n = len(tokens)
    p = min(n, n - (percent * n + 99) // 100 + 1)
    key = (level[(tokens & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (
        tokens >> np.uint64(8))
    at = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
    at = at[np.argsort(key[at])]
    return tokens[at], (n - np.arange(p)) * (100 + percent) // percent - n
