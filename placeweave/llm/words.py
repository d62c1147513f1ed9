"""Words, word hashes and word-window hashes of whole Arrow string columns, in numpy.

A column is read as one byte buffer; a word is a maximal run of bytes other than the six ASCII white-space
characters, so UTF-8 letters stay whole. Work goes in slices of about ``SLICE_BYTES`` so that memory follows
the slice (or the one longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """``_BASE ** i`` modulo 2^64 for i below ``n``."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        grown = np.full(size, _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of len + 1); null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``SLICE_BYTES``; one longer text comes alone."""
    data, at = utf8(column)
    row = 0
    while row + 1 < len(at):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


@dataclass
class Words:
    """Words of consecutive texts: byte bounds, the text each is in, and ``first[d]`` = the first word of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        offset = np.cumsum(length) - length
        inside = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(offset, length)
        source = inside + np.repeat(self.start, length)
        weighted = (self.data[source].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[inside]
        return mix(np.add.reduceat(weighted, offset) + length.astype(np.uint64))


def split(data: np.ndarray, at: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    """Words of the texts that ``data[at[d]:at[d + 1]]`` hold."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = at[:-1]
    before[heads[heads < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    tails = at[1:] - 1
    after[tails[tails >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def windows(hashes: np.ndarray, k: int, base: np.uint64 = np.uint64(0xD6E8FEB86659FD93)) -> np.ndarray:
    """Hash of the ``k`` consecutive word hashes from each position (len - k + 1 of them), by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, size, part, power = None, 0, 1, hashes, np.full(1, base)
    while size <= k:
        if k & size:
            if total is None:
                total = part[:n].copy()
            else:
                total = total * power + part[done:done + n]
            done += size
        part = part[:len(part) - size] * power + part[size:] if len(part) > size else part[:0]
        power = power * power
        size *= 2
    return mix(total)


def inside_one(first: np.ndarray, k: int) -> np.ndarray:
    """Positions from which ``k`` words of one text follow."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    skipped = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first[:-1] - skipped, count)
