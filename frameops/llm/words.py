"""Words, shingles and ranges of whole Arrow text batches as flat numpy arrays.

All separators the operators use are ASCII, so words are found on UTF-8 bytes without a loop over documents. A word's hash is
a polynomial over its (A-Z lower-cased) bytes modulo 2^64, finished by a mixer. Memory is about 40 bytes per text byte of a
chunk; a chunk holds whole documents of ``CHUNK_BYTES`` together, or one longer document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 500_000
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


class Words(NamedTuple):
    """Words of a chunk: byte starts and ends, hashes, and per document the first word (one more entry at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def separators(kind: str) -> np.ndarray:
    """Separator flag by byte: ``space`` splits at x20 and x09-x0D, ``alnum`` keeps digits, letters and non-ASCII bytes."""
    byte = np.arange(256)
    if kind == "space":
        return (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    return (byte <= 0x2F) | ((byte >= 0x3A) & (byte <= 0x60) & ~((byte >= 0x41) & (byte <= 0x5A))) | ((byte >= 0x7B) & (byte <= 0x7F))


@functools.cache
def _byte_values(kind: str) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    values[separators(kind)] = 0
    return values


class _Powers:
    """Powers of the base and of its inverse, as far as the longest chunk needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])) for base in (_P, _P_INVERSE))
        return self.up[:n], self.down


_POWERS = _Powers()


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold at most ``limit`` bytes together; a longer document stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def find_words(data: np.ndarray, offsets: np.ndarray, kind: str) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``; a document's end also ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), data, offsets)
    values = _byte_values(kind)[data]
    solid = values != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = solid[edges]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _POWERS.get(n)
    values *= up
    hashes = np.add.reduceat(values, start) if len(start) else np.zeros(0, np.uint64)
    hashes = mix(hashes * down[start])
    return Words(start, end, hashes, np.searchsorted(start, offsets), data, offsets)


def each_chunk(column: pa.Array, kind: str) -> Iterator[tuple[int, int, Words]]:
    """Words of a text column, chunk by chunk, with the range of rows of each."""
    data, offsets = text_bytes(column)
    for low, high in chunks(offsets):
        yield low, high, find_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], kind)


@functools.cache
def _factors(k: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(977 + k)).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a run may cross documents, the caller drops those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(_factors(k)):
        total += hashes[i : i + n] * factor
    return mix(total)


def shingles(words: Words, i: int, run: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of document i; with fewer words the whole sequence is one, without words none."""
    low, high = words.first[i], words.first[i + 1]
    if high - low >= k:
        return np.unique(run[low : high - k + 1])
    return grams(words.hash[low:high], int(high - low)) if high > low else run[:0]


def doc_of(words: Words) -> np.ndarray:
    """Document index of every word."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
