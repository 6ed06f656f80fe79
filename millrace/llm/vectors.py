"""Embeddings as vectors of whole numbers, and exact sums of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries are counted in steps of 1/SCALE, rounded down.
SCALE = 256
#: Sums are kept in two halves of this many bits, so that neither overflows.
HALF = 32


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vector: Column) -> Column:
    """Each entry c as floor(256 c); beyond the range of a long its nearest end."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint"))


def widest(rows: DataFrame, vector: str = "x") -> int:
    """The greatest number of entries, 0 without rows."""
    return rows.agg(F.max(F.size(vector)).alias("w")).first()["w"] or 0


def padded(vector: Column, width: int) -> Column:
    """The vector with zeros behind it, ``width`` entries in all."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(vector))
    return F.concat(vector, zeros)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longs as (high, low) halves: high * 2**32 + low, with low from 0."""
    return values >> HALF, values & ((1 << HALF) - 1)


def joined(high: int, low: int) -> int:
    return (int(high) << HALF) + int(low)
