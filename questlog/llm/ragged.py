"""Texts as ragged byte arrays: helpers for vectorised work on an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C55


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """BASE ** 0, 1, ... modulo 2**64."""
    global _powers
    if len(_powers) < count:
        full = np.full(max(count, 1024), BASE, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers[:count]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes; spans follow one another and none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(total) - np.repeat(firsts, lengths)
    values = _byte_values()[data if total == len(data) else data[place + np.repeat(starts, lengths)]]
    values *= powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, firsts))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII bytes that are no letters or digits: words between them are free of punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each row and the end): words are runs without `breaks` (ASCII white space), with A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return span_hashes(_LOWER[data], starts, ends - starts), np.searchsorted(starts, offsets)
