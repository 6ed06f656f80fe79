"""Raw rows to typed rows. Narrow steps only, the same on batches and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Field

PROCESSED_AT = "_processed_at"

ORDER_FIELDS = (
    Field("order_id", "string"),
    Field("customer_id", "string"),
    Field("amount", "decimal(18,2)", tolerant=True),
    Field("order_ts", "timestamp"),
)


def conform(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Exactly the given columns with the given types; others are left out."""
    return df.select(*(field.read() for field in fields))


def stamp(df: DataFrame) -> DataFrame:
    """Add the time of processing: one value per query, or per micro-batch."""
    return df.withColumn(PROCESSED_AT, F.current_timestamp())


def transform_orders(df: DataFrame) -> DataFrame:
    """Clean raw orders, whichever readable type their columns arrive in."""
    return stamp(conform(df, ORDER_FIELDS))


def contract(fields: Sequence[Field] = ORDER_FIELDS) -> dict[str, str]:
    """Column names and types that cleaned rows have."""
    return {field.name: field.data_type for field in fields} | {PROCESSED_AT: "timestamp"}
