"""Vectorised kernels over the UTF-8 bytes of Arrow text columns.

A column is walked in slices of about ``SLICE`` bytes (a longer text is a slice of its own), so
memory is bounded by the slice and the longest text. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BLOCK = 1 << 20
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, on unsigned arrays with wrap-around."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    at = (np.arange(1, n + 1, dtype=np.uint64) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15)
    return mix64(at)


_BYTE = random_words(256, 1)
_place = random_words(1 << 10, 2) | _U(1)


def places(n: int) -> np.ndarray:
    """At least ``n`` fixed odd multipliers, one for each place in a word."""
    global _place
    if n > len(_place):
        _place = random_words(1 << int(n - 1).bit_length(), 2) | _U(1)
    return _place


def byte_class(excluded: bytes) -> np.ndarray:
    """A table of 256 flags: bytes of a word are those not in ``excluded``."""
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing A-Z
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, start of each row in bytes with the end appended)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` and how many words precede each row's start (and the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(starts), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts, side="left")


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[begin:end]``; spans ascend and do not overlap."""
    out = np.empty(len(begin), np.uint64)
    done = 0
    while done < len(begin):
        stop = max(done + 1, int(np.searchsorted(end, begin[done] + _BLOCK, side="right")))
        size = end[done:stop] - begin[done:stop]
        before = np.cumsum(size) - size
        within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(before, size)
        at = within + np.repeat(begin[done:stop], size)
        terms = _BYTE[data[at]] * places(int(size.max()))[within]
        out[done:stop] = mix64(np.add.reduceat(terms, before) + size.astype(np.uint64))
        done = stop
    return out


_GRAM = random_words(64, 3) | _U(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (``len(words) - k + 1`` of them)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * _GRAM[j]
    return mix64(total + _U(k))
