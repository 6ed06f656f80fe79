"""Columns of numbers as one binary value, for rows that stand for many."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", 1)


def pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of equal length; bytes of one place lie together, which compresses."""
    parts = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    raw = b"".join([*parts, tail])
    return np.array([len(columns[0]), len(raw)], np.int64).tobytes() + _ZSTD.compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds: type) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns, and what was behind them."""
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    raw = np.frombuffer(_ZSTD.decompress(blob[16:], size, asbytes=True), np.uint8)
    columns, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return columns, raw[at:]


# --- messages between groups: (block, bucket, blob), where a block is told by its number and buckets divide sorted hashes

SENT = "block bigint, bucket bigint, blob binary"


def block_size(total: int, least: int, most: int, roots: int = 64) -> int:
    """Bytes of a block: it grows with the root of all bytes, as the number of messages is the square of that of blocks."""
    return min(max(least, int(roots * total**0.5)), most)


def steps(sorted_: np.ndarray) -> np.ndarray:
    """What each number adds to the one before; ``np.cumsum`` undoes it."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def bucket_of(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """The bucket of hashes of so many bits; larger hashes have no smaller bucket."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def starts_of(sorted_buckets: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins, and the end."""
    return np.searchsorted(sorted_buckets, np.arange(buckets + 1))


def messages(block: int, starts: np.ndarray, made) -> Iterator[tuple[int, int, bytes]]:
    """What ``made`` packs of each bucket that has anything."""
    for bucket in np.flatnonzero(starts[1:] > starts[:-1]):
        yield block, int(bucket), made(slice(starts[bucket], starts[bucket + 1]))


def sent(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    block, bucket, blob = zip(*rows) if (rows := list(rows)) else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blob, pa.binary())})


def answered(answers: pa.Table, starts: np.ndarray, kind: type) -> np.ndarray:
    """A column of answers by bucket, put at its places; what has no answer is 0."""
    out = np.zeros(starts[-1], kind)
    for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()):
        out[starts[bucket] : starts[bucket + 1]] = unpack(blob, kind)[0][0]
    return out
