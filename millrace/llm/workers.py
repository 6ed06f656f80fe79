"""The library on Python workers that cannot import it by themselves."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_ARCHIVE = "millrace-package.zip"


#: Bounds on what a Python worker is handed at once, whatever the length of texts.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, as ``--py-files`` would, once per Spark context, and bound batches."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if any(name.endswith(_ARCHIVE) for name in context.listFiles):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / _ARCHIVE
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, several per executor, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches, after which the worker gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run
