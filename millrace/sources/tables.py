"""Scans of named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The file stream skips files whose modification time lies further back than this
# from the newest one. No two modification times are 270 million years apart, so
# neither an old time nor one far in the future hides another file.
NEVER_TOO_OLD = "100000000000d"

# About eight rounds of 128 MB splits on a thousand executors: large enough to
# fill the cluster, small enough that a failed batch repeats little work.
BATCH_BYTES = 10**12


def scan(spark: SparkSession, table: str, fresh: bool = False) -> DataFrame:
    """The rows of a table; with ``fresh`` also those another job has just added."""
    if fresh:
        spark.catalog.refreshTable(table)
    return spark.read.table(table)


def scan_new_files(
    spark: SparkSession, path: str, schema, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Stream of the rows added to a Parquet folder, in batches of bounded size."""
    return (
        spark.readStream.schema(schema)
        .option("maxFileAge", NEVER_TOO_OLD)
        .option("maxBytesPerTrigger", str(batch_bytes))
        .parquet(path)
    )
