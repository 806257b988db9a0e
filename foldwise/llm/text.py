"""NumPy helpers over the raw bytes of an Arrow string column: word spans and
64-bit word hashes of many texts at once, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 4 << 20
HASHED = 1 << 19        # bytes whose running sums are held at a time
_RNG = np.random.default_rng(20240607)
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[name] = have
    return have


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets of a string array; null reads as ''."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each (or one longer row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(low: np.ndarray, bounds: np.ndarray, cuts: np.ndarray | None = None):
    """Starts and ends of the words of the texts ``low[bounds[i]:bounds[i+1]]``
    (bounds from 0), and for each text the index of its first word, with the
    number of words at the end. ``cuts``: byte positions before which a word is
    cut in two."""
    if len(low) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    word = ~SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[bounds] = True
    if cuts is not None:
        edge[cuts] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, bounds)


def span_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, computed in pieces of bounded size."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + HASHED, "right")))
        a, b = int(s[i]), int(e[j - 1])
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_KEYS[low[a:b]] * _powers("up", BASE, b - a)[:b - a], out=run[1:])
        x, y = s[i:j] - a, e[i:j] - a
        raw = (run[y] - run[x]) * _powers("down", BASE_INV, b - a + 1)[x]
        out[i:j] = mix(raw + (y - x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """Lower-cased bytes of rows i..j-1, word starts, ends, word hashes and the
    first word of each row."""
    low = LOWER[raw[offsets[i]:offsets[j]]]
    s, e, first = word_spans(low, offsets[i:j + 1] - offsets[i])
    return low, s, e, span_hashes(low, s, e), first
