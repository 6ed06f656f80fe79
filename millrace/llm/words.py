"""Words of Arrow text batches as numpy arrays, without a Python object per word.

A batch's texts lie end to end in one byte buffer. Bytes are mapped to
themselves, to a lower-case letter or to 0 (a separator), words are the runs
between separators, and each word gets a 64-bit hash from differences of one
running polynomial sum. All separators are ASCII, so bytes serve for UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Work is cut into pieces of about this many bytes (whole texts), which bounds memory.
CHUNK_BYTES = 1 << 18

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_WEIGHTS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """What each byte stands for: 0 for separators, A-Z as a-z if asked for."""
    table = np.arange(256, dtype=np.uint8)
    table[list(separators)] = 0
    table[0] = 0 if 0 in separators else 0xFF  # a NUL in a word must not look like a separator; 0xFF is never in UTF-8
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > 8 * CHUNK_BYTES:  # not kept for one enormous text
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


class Texts(NamedTuple):
    """Some rows' texts: the bytes, and where each row begins and ends in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The rows of a text column in order, in pieces of about ``limit`` bytes. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def running_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each stretch of bytes, from differences of one running sum."""
    n = len(data)
    powers, inverse = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_WEIGHTS[data] * powers[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts: Texts, table: np.ndarray) -> Words:
    """The words of the rows, in order. ``row`` counts from the piece's first row."""
    folded = table[texts.data]
    inside = folded != 0
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none.astype(np.uint64), none, none)
    edges = texts.offsets[1:-1]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[edges[edges <= n]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    after[edges] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    hashes = running_hashes(folded, starts, ends)
    rows = np.searchsorted(texts.offsets, starts, "right") - 1
    return Words(rows, hashes, starts, ends)


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of n consecutive words of a row."""
    m = len(found.row) - n + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64)
    total = found.hash[:m].copy()
    for k in range(1, n):
        total = mix(total) + found.hash[k : m + k] * _U64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(found.row[:m] == found.row[n - 1 : m + n - 1])
    return at, mix(total[at])
