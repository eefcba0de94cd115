"""Vectorised tokenising of Arrow string columns, for use inside tasks.

Texts are handled whole, as UTF-8 bytes in slices of whole documents. A word is a
maximal run of bytes other than space and 0x09-0x0D. Word identities are 64-bit
hashes; two words of one corpus share one with probability below 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are tokenised at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of up to so many bytes are hashed by eight bytes at a time.
_SHORT = 64


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a slice of documents. ``first[d] : first[d + 1]`` are the words of document ``d``."""

    data: np.ndarray  # bytes of all documents, lower-cased if asked for
    bounds: np.ndarray  # byte offsets of the documents
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit identity of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        eight = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), 0, 1)  # the eight bytes from each place on

        def read(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            return eight[at] << (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8))

        out = mix64(np.where(size > 0, read(self.start, np.maximum(size, 1)), np.uint64(0)) + size.astype(np.uint64) * _BASE)
        going = np.flatnonzero((size > 8) & (size <= _SHORT))
        for done in range(8, _SHORT, 8):
            out[going] = mix64(out[going] + mix64(read(self.start[going] + done, size[going] - done)))
            going = going[size[going] > done + 8]
        long = np.flatnonzero(size > _SHORT)
        if len(long):
            out[long] = self._long(self.start[long], self.end[long])
        return out

    def _long(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identities of words of any length, from running sums over all bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * _cached(n, _BASE)[:n], out=total[1:])
        return mix64((total[end] - total[start]) * _cached(n, _INVERSE)[start] + (end - start).astype(np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _cached(n: int, base: np.uint64) -> np.ndarray:
    if n > SLICE_BYTES:
        return _powers(n, base)
    if int(base) not in _POWERS:
        _POWERS[int(base)] = _powers(SLICE_BYTES, base)
    return _POWERS[int(base)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``most`` bytes, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool) -> Words:
    """The words of documents ``lo`` to ``hi``."""
    bounds = offsets[lo : hi + 1] - offsets[lo]
    part = data[offsets[lo] : offsets[hi]]
    if lower:  # A to Z lack the bit that makes them a to z
        part = part | ((part - np.uint8(ord("A"))) < 26).view(np.uint8) * np.uint8(32)
    inside = np.empty(len(part) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not((part == 0x20) | ((part - np.uint8(0x09)) < 5), out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(part))]
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    start = np.flatnonzero(begins)
    return Words(part, bounds, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def each_slice(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """``(lo, hi, words)`` over all documents of a column."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        yield lo, hi, words(data, offsets, lo, hi, lower)
