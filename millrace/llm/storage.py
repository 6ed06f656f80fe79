"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.session import shared_folder


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, so lost executors repeat no earlier step, and the
    planner then knows the table's true size.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
