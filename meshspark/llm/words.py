"""Hashes of words and word shingles over the bytes of a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SALT = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(20240502).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts and the last ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in turn, A-Z lower-cased: 64-bit hashes and the first three bytes (-1 past the
    end); and the number of words of each row."""
    raw, offsets = utf8(column)
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64), np.empty((0, 3), np.int64), np.zeros(len(offsets) - 1, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    first = np.flatnonzero(begins[at])  # in places of bytes inside words
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64), dtype=np.uint64)
    sums = np.add.reduceat(_SALT[low[at]] * powers[place], first)
    per_row = np.diff(np.searchsorted(at[first], offsets))
    start = at[first]
    heads = np.stack([np.where(lengths > j, low[np.minimum(start + j, len(low) - 1)].astype(np.int64), -1) for j in range(3)], axis=1)
    return mixed(sums ^ lengths.astype(np.uint64)), heads, per_row


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in turn, A-Z lower-cased, and the number of words of each row."""
    hashes, _, per_row = word_parts(column)
    return hashes, per_row


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row's ``k``-word shingles in turn, and their number by row.
    Fewer words than ``k`` are one shingle; a row without words has none."""
    words, per_row = word_hashes(column)
    n = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    row = np.repeat(np.arange(len(per_row)), n)
    first = np.repeat(np.cumsum(per_row) - per_row - (np.cumsum(n) - n), n) + np.arange(len(row))
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    left = np.repeat(per_row, n)
    total = np.zeros(len(row), np.uint64)
    for j in range(k):
        total += np.where(j < left, padded[first + j] * _PLACES[j], np.uint64(j + 1))
    total = mixed(total)
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    return total[keep], np.bincount(row[keep], minlength=len(per_row)).astype(np.int64)
