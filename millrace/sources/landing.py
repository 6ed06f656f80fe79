"""JSON files arriving in a landing zone, read as a stream of all-text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import BATCH_BYTES, NEVER_TOO_OLD

LANDED_ORDERS = "order_id STRING, customer_id STRING, amount STRING, order_ts STRING"


def source_path(spark: SparkSession) -> str:
    """The landing path the session is configured with; an absent one is an error."""
    path = spark.conf.get("source_path")
    if not path.strip():
        raise ValueError("source_path is set but empty")
    return path


def landing_path(root: str, source: str) -> str:
    """Each source has its own directory directly below the landing root."""
    if not source or "/" in source or source.startswith((".", "_")):
        raise ValueError(f"not a source directory name: {source!r}")
    return f"{root.rstrip('/')}/{source}"


def landing_stream(
    spark: SparkSession,
    path: str,
    schema: str = LANDED_ORDERS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Stream of the JSON lines below ``path``, each file once.

    The schema is given, never inferred: numbers arrive as their text, unknown
    fields are left out, missing ones and unreadable lines are NULL. Files in
    nested directories are read too, and directory names add no columns.
    """
    return (
        spark.readStream.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true")
        .option("maxFileAge", NEVER_TOO_OLD)
        .option("maxBytesPerTrigger", str(batch_bytes))
        .json(path)
    )


def read_landing(
    spark: SparkSession,
    root: str,
    source: str = "orders",
    schema: str = LANDED_ORDERS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Stream of one source of a landing zone."""
    return landing_stream(spark, landing_path(root, source), schema, batch_bytes)
