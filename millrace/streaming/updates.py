"""Bringing a folder of rows up to date with a stream, once, when asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import Expectation, expect_and_count, expectation_counts
from ..sources import scan_new_files

_METRICS = "row_counts"
_RECORD = "batch LONG, reported BOOLEAN, seen LONG, dropped LONG, failed MAP<STRING, LONG>"


@dataclass(frozen=True)
class Counts:
    """Rows a step read, rows it dropped, and rows failing each expectation."""

    seen: int = 0
    dropped: int = 0
    failed: Mapping[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, metrics: Mapping[str, int]) -> Counts:
        failed = {name: n for name, n in metrics.items() if name not in ("seen", "dropped")}
        return cls(metrics.get("seen", 0), metrics.get("dropped", 0), failed)

    def __add__(self, other: Counts) -> Counts:
        failed = {n: self.failed.get(n, 0) + other.failed.get(n, 0) for n in {**self.failed, **other.failed}}
        return Counts(self.seen + other.seen, self.dropped + other.dropped, failed)


def append_available(
    stream: DataFrame, path: str, checkpoint: str, expectations: Sequence[Expectation] = ()
) -> Counts:
    """Append what the stream has to offer now, then stop, and count it.

    The counts are those of all rows offered since the last call that returned some: over
    all calls each row counts once, cut-off ones included.
    """
    append(stream, path, checkpoint, expectations)
    counting = start_counting(stream, path, checkpoint, expectations)
    return counted(counting, stream.sparkSession, checkpoint)


def append(
    stream: DataFrame, path: str, checkpoint: str, expectations: Sequence[Expectation] = ()
) -> None:
    """Append what the stream has to offer now and meets all expectations, then stop.

    Work is bounded per micro-batch by the source, and a batch that was cut off
    is repeated as a whole by the next run: the sink's log shows readers each
    batch once. The filter stays above all strict casts, as the rows are looked at before it.
    """
    query = (
        expect_and_count(stream, _METRICS, expectations)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    _to_its_end(query)


def start_counting(
    stream: DataFrame, path: str, checkpoint: str, expectations: Sequence[Expectation] = ()
) -> StreamingQuery:
    """Start to count what was offered to an append that has ended.

    Counting is a stream with a checkpoint of its own. Every batch's counts are written
    under its number before the batch is committed, and a repeated batch overwrites its own, so a row counts once
    wherever a run is cut off. With expectations the rows offered are read again, the
    conditions' columns only; without any, the rows appended, of which only the number is read.
    """
    spark = stream.sparkSession
    folder = _counts_folder(checkpoint)
    # Hidden, but the folder around it is there to be read from the start.
    spark.createDataFrame([], _RECORD).coalesce(1).write.mode("ignore").parquet(f"{folder}/batches/_start")
    rows = stream if expectations else scan_new_files(spark, path, stream.schema)

    def put_down(batch: DataFrame, number: int) -> None:
        failed = F.map_from_arrays(
            F.array(*(F.lit(e.name) for e in expectations)).cast("array<string>"),
            F.array(*(F.col(f"`{e.name}`") for e in expectations)).cast("array<bigint>"),
        )
        line = expectation_counts(batch, *expectations).select(F.lit(number).cast("bigint").alias("batch"), F.lit(False).alias("reported"), "seen", "dropped", failed.alias("failed"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/{number:012d}")

    return (
        rows.writeStream.foreachBatch(put_down)
        .option("checkpointLocation", f"{folder}/ckpt")
        .trigger(availableNow=True)
        .start()
    )


def counted(counting: StreamingQuery, spark: SparkSession, checkpoint: str) -> Counts:
    """Wait for the counting to end; the sum of what it and cut-off runs before it have counted."""
    _to_its_end(counting)
    return _put_on_record(spark, _counts_folder(checkpoint))


def _to_its_end(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _counts_folder(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-counts"


def _put_on_record(spark: SparkSession, folder: str) -> Counts:
    """The sum of the batches that no call has reported yet; from now on they are reported."""
    lines = spark.read.schema(_RECORD).option("recursiveFileLookup", "true").parquet(f"{folder}/batches")
    last = lines.filter("reported").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("batch")).scalar()
    new = lines.filter(~F.col("reported") & (F.col("batch") > last)).collect()  # one row per batch since the last call
    if new:
        number = max(r.batch for r in new)
        mark = spark.createDataFrame([(number, True, None, None, None)], _RECORD)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches/reported-{number:012d}")
    return sum((Counts(r.seen, r.dropped, r.failed) for r in new), Counts())
