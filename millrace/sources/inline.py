"""Raw orders built in the program, for trying the tables without landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The five sample rows. One amount cannot be read as a number and
# one row has no id, so both cleaning rules have something to act on.
SAMPLE_SCHEMA = "order_id INT, customer_id STRING, amount STRING, order_ts STRING"
SAMPLE_ORDERS = [
    (1, "cust-001", "42.50", "2026-08-01 09:15:00"),
    (2, "cust-002", "17.99", "2026-08-01 11:42:00"),
    (3, "cust-001", "128.00", "2026-08-02 08:03:00"),
    (4, "cust-003", "not-a-number", "2026-08-02 14:20:00"),
    (None, "cust-004", "99.99", "2026-08-02 16:58:00"),
]


def orders_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_ORDERS, SAMPLE_SCHEMA)
