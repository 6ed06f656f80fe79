"""Compression of vectors to one code per part, with nearest entries found by Walsh-Hadamard coefficients.

Vectors and codebook entries are whole numbers, cut into equal parts. A part, filled with zeros to a power of two m,
and an entry are transformed by the same Walsh-Hadamard matrix of +1 and -1; m times
their squared distance is the sum of the squared differences of coefficients. The sum runs from the lowest
sequency up, where parts of embeddings differ most on average, and an entry goes as soon as it is above the whole sum
of one that came near in the first coefficient. All of it is whole numbers, so nearest entries and ties are exact.

Spark sums the parts of each entry (a row per entry, place and task); the codebooks, whose size depends on
parts and entries only, go to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .vectors import halves, joined, matrix, padded, usable, whole, widest

PARTS = 16
ENTRIES = 64
ROUNDS = 2


def walsh(m: int) -> np.ndarray:
    """The Hadamard matrix of size m (a power of two), rows by sequency: by how often they change sign."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")]


def _coefficients(parts: np.ndarray, h: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(parts), len(h)), parts.dtype)
    wide[:, : parts.shape[1]] = parts
    return wide @ h.T.astype(parts.dtype)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the lower of equals, and the squared distance to it."""
    m = 1
    while m < parts.shape[1]:
        m *= 2
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in (parts, entries) if a.size), default=0)
    if 4 * m**3 * most**2 >= 1 << 62:  # beyond 64 bits Python's whole numbers take over
        parts, entries = parts.astype(object), entries.astype(object)
    h = walsh(m)
    ours, theirs = _coefficients(parts, h), _coefficients(entries, h)
    first = (ours[:, :1] - theirs[:, 0][None, :]) ** 2
    near = first.argmin(1)
    bound = ((ours - theirs[near]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    partial = first[row, entry]
    for j in range(1, m):
        partial = partial + (ours[row, j] - theirs[entry, j]) ** 2
        left = partial <= bound[row]
        row, entry, partial = row[left], entry[left], partial[left]
    starts = np.searchsorted(row, np.arange(len(parts)))
    least = np.minimum.reduceat(partial, starts) if len(parts) else partial
    at = np.flatnonzero(partial == least[row])
    at = at[np.append(True, row[at][1:] != row[at][:-1])] if len(at) else at
    return entry[at], least // m


def assigned(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per row and part the index of the nearest entry, and per part the squared distances."""
    count, _, size = codebooks.shape
    found = [nearest(x[:, p * size : (p + 1) * size], codebooks[p]) for p in range(count)]
    return np.stack([f[0] for f in found], 1), [f[1] for f in found]


def improved(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the mean, rounded down, of the parts it is nearest to."""
    count, entries, size = codebooks.shape
    slots = entries * size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, count, slots), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), count * size)
            codes, _ = assigned(x, codebooks)
            for p in range(count):
                at = (codes[:, p, None] * size + np.arange(size)).reshape(-1)
                high, low = halves(x[:, p * size : (p + 1) * size].reshape(-1))
                # A batch's halves sum to less than 2^53, so sums of doubles are exact.
                for k, values in enumerate((high, low, None)):
                    total[k, p] += np.bincount(at, None if values is None else values.astype(float), slots).astype(np.int64)
        part, slot = np.nonzero(total[2])
        columns = [part, slot, *(total[k, part, slot] for k in range(3))]
        yield pa.record_batch([pa.array(c) for c in columns], ["part", "slot", "high", "low", "n"])

    found = rows.select("x").mapInArrow(sums, "part bigint, slot bigint, high bigint, low bigint, n bigint")
    found = found.groupBy("part", "slot").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n")))
    better = codebooks.copy()
    for r in found.collect():  # at most one per part, entry and place
        better[r["part"], r["slot"] // size, r["slot"] % size] = joined(r["high"], r["low"]) // r["n"]
    return better


def learn(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks [part, entry, place]: the first rows by ``_id`` (nulls last, then by vector), improved ``rounds`` times."""
    first = rows.orderBy(F.col("_id").isNull(), "_id", "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width // parts)
    codebooks = start.transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        codebooks = improved(rows, codebooks)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, *, doc: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Per row ``doc``, ``label``, ``code``, ``error`` and ``label_error``; and the codebooks [part, entry, place].

    Rows whose vector is null or has a null or non-finite entry are left out, all others come back,
    repeated rows and null ids too. Each entry c counts as floor(256 c); beyond a long as its end. ``code`` has two hex digits per part,
    ``error`` is the squared distance to the entries it names, ``label_error`` the sum over rows of one label, nulls being
    one label. Sums beyond a long are null. At most 256 ``entries``; with fewer rows there are as many entries as rows.

    Vectors of unequal length, or of one that ``parts`` does not divide, are filled with zeros behind. Repeated ids are taken in
    the order of their vectors. No rows give no rows and empty codebooks. Other columns are not carried.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    chosen = vectors.select(F.col(doc).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v")).where(usable(F.col("_v")))
    kept = materialise(chosen.select("_id", "_label", whole(F.col("_v")).alias("x")), "compression-rows")
    width = -(-max(widest(kept), 1) // parts) * parts
    rows = kept.withColumn("x", padded(F.col("x"), width))
    codebooks = learn(rows, width, parts, entries, rounds)

    @F.arrow_udf("struct<code:string,error:bigint>")
    def encode(column: pa.Array) -> pa.Array:
        codes, distances = assigned(matrix(column, width), codebooks)
        names = [bytes(c).hex() for c in codes.astype(np.uint8)]
        error = [sum(d) for d in zip(*(d.tolist() for d in distances))]
        error = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), error], ["code", "error"])

    coded = rows.select("_id", "_label", encode("x").alias("c")).select("_id", "_label", "c.code", "c.error")
    coded = materialise(coded, "compression-codes")
    # Summed in every task first, so a label with many rows is a few rows.
    whole_sum = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)")))
    by_label = coded.groupBy(F.col("_label").alias("_of")).agg(whole_sum.try_cast("bigint").alias("label_error"))
    found = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return found.select(F.col("_id").alias(doc), F.col("_label").alias(label), "code", "error", "label_error"), codebooks
