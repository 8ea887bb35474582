"""Texts of an Arrow batch as one flat byte array, with words and their hashes found by numpy over all texts at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text makes a piece of its own.
PIECE = 1 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def tidy() -> None:
    """At the end of a task: give back the memory that this process no longer uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows: row i of the run has bytes[offsets[i]:offsets[i + 1]]. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Word spans and 64-bit hashes. ``inside`` says for each byte value whether it belongs to a word; A-Z count as a-z."""

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        fold = np.arange(256)
        fold[65:91] += 32
        with np.errstate(over="ignore"):
            self.value = mix(np.arange(1, 257, dtype=U64) * _ODD)[fold]
        self.power = self.back = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                base = U64(0xD6E8FEB86659FD93)
                inverse = U64(pow(int(base), -1, 1 << 64))
                self.power, self.back = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n + 1, b, U64)])) for b in (base, inverse))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words, and for each row how many words come before it (with the total at the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
        self._grow(n)
        word = self.inside[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edge = offsets[offsets < n]
        begins[edge] = word[edge]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        edge = edge[edge > 0] - 1
        ends[edge] = word[edge]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U64)
            np.cumsum(np.where(word, self.value[data], U64(0)) * self.power[:n], out=total[1:])
            hashes = mix((total[end] - total[start]) * self.back[start] + (end - start).astype(U64) * _ODD)
        return start, end, hashes, np.searchsorted(start, offsets)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: ASCII letters and digits and all that is not ASCII.
ALNUM = _bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but ASCII white space.
SOLID = ~_bytes((0x20, 0x20), (0x09, 0x0D))


def shingles(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``width`` words of a row; a row of fewer words, but not none, has one run of all its words."""
    n = len(hashes)
    counts = np.diff(before)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - before[:-1][row]
    left = np.minimum(width, counts[row] - place)
    with np.errstate(over="ignore"):
        total = left.astype(U64) * _ODD
        for j in range(width):
            ok = left > j
            at = np.flatnonzero(ok)
            total[at] += mix(hashes[at + j] + U64(j + 1) * _ODD)
    real = (left == width) | (place == 0)
    return row[real], mix(total[real])
