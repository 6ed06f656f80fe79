"""Whitening of embeddings by their leading principal components.

The covariance is summed by Spark over the distinct vectors, each centred before it is multiplied.
Of the one small matrix that comes out, Householder reflections, Sturm counts and inverse iteration (``eigen``)
give the leading components; their matrix goes to all tasks, which project every row.

Sums of whole numbers are exact at any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eigen import leading
from .storage import materialise
from .vectors import halves, joined, matrix, padded, usable, whole, widest

COMPONENTS = 4


def column_sums(vectors: DataFrame, width: int) -> list[int]:
    """The sum of every entry over all rows of ``x``, exact; one row per entry and task is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            parts = halves(matrix(batch.column("x"), width))
            high, low = high + parts[0].sum(0), low + parts[1].sum(0)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    found = vectors.select("x").mapInArrow(sums, "i bigint, high bigint, low bigint")
    rows = found.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # one per entry
    out = [0] * width
    for r in rows:
        out[r["i"]] = joined(r["high"], r["low"])
    return out


def _projected(values: np.ndarray, mean: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    centred = values - mean
    return centred if axes is None else centred @ axes


def means(vectors: DataFrame, n: int, width: int, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The means of the projected rows of ``x``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(axes.shape[1])
        for batch in batches:
            total += _projected(matrix(batch.column("x"), width), mean, axes).sum(0)
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

    found = vectors.select("x").mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s"))
    out = np.zeros(axes.shape[1])
    for r in found.collect():
        out[r["i"]] = r["s"] / n
    return out


def covariance(
    vectors: DataFrame, n: int, width: int, mean: np.ndarray, axes: np.ndarray | None = None, centre: np.ndarray | None = None
) -> np.ndarray:
    """The covariance, divisor n, of the rows of ``x`` less ``mean``, or of their projections less ``centre``.

    Rows are centred before they are multiplied. Every task sums its own products; a row per pair of
    entries and task is shuffled, whatever the number of vectors.
    """
    size = width if axes is None else axes.shape[1]
    upper = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = _projected(matrix(batch.column("x"), width), mean, axes)
            y = y if centre is None else y - centre
            total += y.T @ y
        yield pa.record_batch([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "s"])

    found = vectors.select("x").mapInArrow(products, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((size, size))
    for r in found.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / n
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over entries of (n x - S)^2 per row, exact: n^2 sum(x^2) - 2 n sum(x S) + sum(S^2)."""
    if not x.size:
        return [0] * len(x)
    most, width = max(int(x.max()), -int(x.min())), x.shape[1]
    if most * most * width >= 1 << 62 or most * width >= 1 << 30 or max(map(abs, sums)) >= 1 << 62:
        return [int(d) for d in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)]
    high, low = halves(np.array(sums, np.int64))
    own = (x * x).sum(1).tolist()
    mixed = [joined(h, m) for h, m in zip((x @ high).tolist(), (x @ low).tolist())]
    rest = sum(s * s for s in sums)
    return [n * n * a - 2 * n * b + rest for a, b in zip(own, mixed)]


def whiten(vectors: DataFrame, *, doc: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component (from 1): ``doc``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or has a null or non-finite entry are left out; every other row comes
    back once per component, repeated rows and null ids too. Each entry c counts as x = floor(256 c). The
    components are fitted on each distinct x once: ``n`` of them. ``deviation`` (decimal) is the sum of (n x - S)^2 over
    the entries, exact up to 38 digits and null beyond; ``whitened`` the projection of x - S/n over the square root of the
    component's variance e; ``explained`` e over the whole variance; ``identity_error`` how far
    the covariance of ``whitened`` over the fit list is from the identity, at most.

    Vectors of unequal length are filled with zeros to the longest. A component without variance, as with
    fewer distinct vectors than components, has a null ``whitened`` and no part in ``identity_error``, which is null if all
    are such; ``explained`` is then 0, or null if nothing varies. With fewer entries than ``components`` there are as many
    components as entries. No rows give no rows. Other columns are not carried. Entries beyond a long count as its end.
    """
    chosen = vectors.select(F.col(doc).alias("_id"), F.col(vector).alias("_v")).where(usable(F.col("_v")))
    rows = materialise(chosen.select("_id", whole(F.col("_v")).alias("x")), "whitening-rows")
    width = widest(rows)
    filled = rows.select("_id", padded(F.col("x"), width).alias("x"))
    fitted = materialise(filled.select("x").distinct(), "whitening-fit")
    n = fitted.count()
    sums = column_sums(fitted, width)
    mean = np.array([s / max(n, 1) for s in sums])
    spread = covariance(fitted, max(n, 1), width, mean)
    trace = float(np.trace(spread))
    values, axes = leading(spread, components)
    varies = values > width * np.finfo(float).eps * trace
    scaled = axes[:, varies] / np.sqrt(values[varies])
    error = None
    if varies.any():
        centre = means(fitted, n, width, mean, scaled)
        found = covariance(fitted, n, width, mean, scaled, centre)
        error = float(np.abs(found - np.eye(len(found))).max())

    @F.arrow_udf("struct<deviation:string,whitened:array<double>>")
    def project(column: pa.Array) -> pa.Array:
        x = matrix(column, width)
        out = np.zeros((len(x), len(values)))
        out[:, varies] = (x - mean) @ scaled
        flat = pa.array(out.reshape(-1), mask=np.tile(~varies, len(x)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(values), pa.int32()), flat)
        exact = pa.array([str(d) for d in deviations(x, n, sums)], pa.string())
        return pa.StructArray.from_arrays([exact, lists], ["deviation", "whitened"])

    shares = F.array(*(F.lit(float(v) / trace if ok else 0.0) if trace > 0 else F.lit(None).cast("double") for v, ok in zip(values, varies)))
    projected = filled.select("_id", project("x").alias("p"))
    lines = projected.select("_id", F.col("p.deviation").alias("deviation"), F.posexplode("p.whitened").alias("at", "whitened"))
    return lines.select(
        F.col("_id").alias(doc),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        "whitened",
        (F.get(shares, F.col("at")) if len(values) else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
