"""Word hashes of many texts at once, over their UTF-8 bytes.

Words are runs of bytes other than space and the controls 0x09 to 0x0D, with A-Z in lower case.  A word's
hash is a polynomial of its bytes modulo 2^64, taken from one running sum over the batch, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += U(32)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(tables)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its texts; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_in(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a run of bytes marked ``inside`` that stays in one text."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Spans:
    """Hashes of any spans of a batch's bytes, in lower case, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = _power_tables(n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data] + U(1)) * up[:n], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        return mix((self.total[end] - self.total[start]) * self.down[start] + size)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 positions where each text's words begin."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    start, end = words_in(data, offsets, ~_SPACE[data])
    return Spans(data).hash(start, end), np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words.

    A text of fewer words is one shingle, its whole sequence; one without words has none.
    """
    data, offsets = text_bytes(texts)
    hashes, at = word_hashes(data, offsets)
    whole = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | U(1)
    for i in range(words):
        whole += hashes[i:len(hashes) - words + 1 + i] * factors[i]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:
            short = (hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64) + U(b - a)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
