"""Comparison of two tables as bags of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

_BUCKET = "_unequal_bucket"


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that do not occur equally often on both sides, with both counts.

    Both sides are read once and meet in one aggregation. Equal rows are counted
    before they are shuffled, so a row repeated many times costs one record per
    task. NULLs compare equal.
    """
    columns = left.columns
    if len(set(columns)) != len(columns) or sorted(columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {columns} and {right.columns}")

    def tagged(df: DataFrame, in_left: int, in_right: int) -> DataFrame:
        sides = (F.lit(in_left).alias("in_left"), F.lit(in_right).alias("in_right"))
        return df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *sides)

    return (
        tagged(left, 1, 0)
        .unionAll(tagged(right, 0, 1))
        .groupBy("row")
        .agg(F.sum("in_left").alias("left_count"), F.sum("in_right").alias("right_count"))
        .filter(F.col("left_count") != F.col("right_count"))
        .select("row.*", "left_count", "right_count")
    )


#: Buckets of rows whose digests are compared: a row of seven numbers each, whatever the size of the tables.
DIGEST_BUCKETS = 4096


def _row_hashes(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes of a row. NULLs are marked, as the hash function itself passes over them, also within nested values."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (ArrayType, StructType))}
    named = [F.col(f"`{c}`") for c in columns]
    written = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if name in nested else c for name, c in zip(columns, named)]
    parts = [*written, *(c.isNull() for c in named)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def bucket_digests(df: DataFrame, columns: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Per bucket of row hashes the number of rows and the sums of both hashes, each in two halves.

    One narrow pass: rows are summed by hash where they lie. Equal bags of rows have equal digests; different ones
    have, but for a chance of about 2**-128 a bucket. Halves cannot overflow under 2**31 rows a bucket.
    """
    one, two = _row_hashes(df, columns)
    hashed = df.select(one.alias("one"), two.alias("two"))
    half = lambda name: (F.shiftrightunsigned(name, 32), F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = [F.sum(h).alias(f"{name}_{i}") for name in ("one", "two") for i, h in enumerate(half(name))]
    return hashed.groupBy(F.pmod("one", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), *sums)


def unequal_buckets(left: DataFrame, right: DataFrame, columns: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """The buckets in which two tables differ, at most ``buckets`` rows."""
    both = [bucket_digests(df, columns, buckets) for df in (left, right)]
    numbers = [c for c in both[0].columns if c != "bucket"]
    signed = both[0].unionAll(both[1].select("bucket", *((-F.col(c)).alias(c) for c in numbers)))
    summed = signed.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in numbers))
    return summed.filter(" OR ".join(f"{c} <> 0" for c in numbers)).select("bucket")


def differing_rows(left: DataFrame, right: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """The result of ``table_difference`` for tables that are mostly equal, however large.

    Digests are compared first, in one narrow pass over each side; then only rows of unequal buckets are read again and
    shuffled. Equal tables are never shuffled. The list of buckets is bounded and sent to all tasks. Tables that
    differ everywhere cost that pass on top. Columns of maps, which have no hash, are compared directly.
    """
    columns = left.columns
    if any("map<" in data_type for _, data_type in left.dtypes + right.dtypes) or sorted(left.dtypes) != sorted(right.dtypes):
        return table_difference(left, right)
    right = right.select(*(f"`{c}`" for c in columns))
    unequal = F.broadcast(unequal_buckets(left, right, columns, buckets).withColumnRenamed("bucket", _BUCKET))

    def of_them(df: DataFrame) -> DataFrame:
        bucket = F.pmod(_row_hashes(df, columns)[0], F.lit(buckets))
        return df.join(unequal, bucket == F.col(_BUCKET), "left_semi")

    return table_difference(of_them(left), of_them(right))


def require_same_rows(left: DataFrame, right: DataFrame, shown: int = 5) -> None:
    """Raise unless both tables have the same columns, types and rows, in any order."""
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise AssertionError(f"schemas differ: {left.dtypes} and {right.dtypes}")
    if differing := differing_rows(left, right).take(shown):
        listed = "\n".join(str(row) for row in differing)
        raise AssertionError(f"tables differ, for example:\n{listed}")
