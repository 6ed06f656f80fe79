"""Tables as pointers to generations of files.

A generation is one complete, separately written copy of a pipeline's tables:
``<database>/generations/<pipeline>/gen=<id>/<table>/{data,ckpt}``. A catalog
table shows the ``data`` folder of one generation. Replacing the contents of a
table means writing a new generation and then moving the pointer, so readers see
the old rows or the new rows, and a failed job leaves the old ones in place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Generation:
    """One copy of the tables of a pipeline."""

    folder: str

    @property
    def id(self) -> str:
        return self.folder.rpartition("/gen=")[2]

    @property
    def streamed(self) -> bool:
        """Whether it was written by streams, whose checkpoints an update can go on from."""
        return self.id.endswith("-stream")

    def data(self, table: str) -> str:
        return f"{self.folder}/{_short(table)}/data"

    def checkpoint(self, table: str) -> str:
        return f"{self.folder}/{_short(table)}/ckpt"


def _short(table: str) -> str:
    return table.rpartition(".")[2]


def _database_folder(spark: SparkSession, table: str) -> str:
    name = table.rpartition(".")[0] or spark.catalog.currentDatabase()
    return spark.catalog.getDatabase(name).locationUri.rstrip("/")


def pipeline_folder(spark: SparkSession, table: str) -> str:
    """Where the pipeline that ends in ``table`` keeps its generations, journal and leases."""
    return f"{_database_folder(spark, table)}/generations/{_short(table)}"


def new_generation(spark: SparkSession, table: str, streamed: bool) -> Generation:
    """An unused generation of the pipeline that ends in ``table``."""
    written = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    kind = "stream" if streamed else "batch"
    return Generation(f"{pipeline_folder(spark, table)}/gen={written}-{uuid4().hex[:12]}-{kind}")


def current_generation(spark: SparkSession, table: str) -> Generation | None:
    """The generation ``table`` shows, or None before the first one.

    A table that shows anything else belongs to somebody else: that is an error.
    """
    if not spark.catalog.tableExists(table):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0]
    location = json.loads(described)["location"].rstrip("/")
    folder, found, _ = location.rpartition(f"/{_short(table)}/data")
    if not found or "/gen=" not in folder:
        raise ValueError(f"{table} shows {location}, which no pipeline here wrote")
    return Generation(folder)


def retire_generations(spark: SparkSession, table: str, keep: int = 1) -> list[str]:
    """Delete generations older than the one shown, except the newest ``keep`` of them and those that are being read.

    Replacing a table leaves the files it showed before, for readers still at
    work and for going back. Ids begin with the time of writing, so a generation
    being written now is newer than the one shown and is not touched. One that a reader has a
    lease on (``reading``) stays, and goes with a later call; while a move of the tables has not ended, all stay. The
    pipeline is named by its last table. Returns the ids that were deleted.
    """
    from .journal import open_move
    from .leases import give_up

    if open_move(spark, table) is not None:
        return []  # under way, or cut off: then the next run needs the files it came from
    current = current_generation(spark, table)
    if current is None:
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(current.folder).getParent()
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = (status.getPath().getName() for status in files.listStatus(folder))
    ids = sorted(name.removeprefix("gen=") for name in names if name.startswith("gen="))
    older = [name for name in ids if name < current.id]
    unread = [name for name in older[: max(len(older) - keep, 0)] if give_up(spark, Generation(f"{folder}/gen={name}"))]
    for name in unread:
        files.delete(hadoop.Path(folder, f"gen={name}"), True)
        files.delete(hadoop.Path(folder, f"leases/{name}"), True)
    return unread


def _columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(column.name, column.dataType) for column in spark.catalog.listColumns(table)]


def _beside(table: str, mark: str) -> tuple[str, str]:
    return f"{table}_new_{mark}", f"{table}_old_{mark}"


def repair_entry(spark: SparkSession, table: str, mark: str) -> None:
    """Give ``table`` an entry again, and take away those beside it, after a replacement that was cut off."""
    ready, old = _beside(table, mark)
    if spark.catalog.tableExists(old):
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE {old}")
        else:
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {ready}")


def _replace_entry(spark: SparkSession, table: str, path: str, schema: StructType, exists: bool, mark: str) -> None:
    """A new catalog entry for other columns, made under another name first.

    Renaming changes only the catalog. The old entry goes when the new one has its name,
    and comes back if it cannot have it; tables are external, so files stay.
    """
    if not exists:
        spark.catalog.createTable(table, path=path, source="parquet", schema=schema)
        return
    ready, old = _beside(table, mark)
    spark.catalog.createTable(ready, path=path, source="parquet", schema=schema)
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {ready} RENAME TO {table}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        raise
    spark.sql(f"DROP TABLE {old}")


def show(
    spark: SparkSession, table: str, generation: Generation, schema: StructType, comment: str, mark: str | None = None
) -> None:
    """Let ``table`` show a generation, creating or retyping the catalog entry if needed.

    Only the catalog is consulted; the files of the old generation are not listed. Entries made on the way have ``mark`` in their
    names, by which ``repair_entry`` finds them.
    """
    path = generation.data(table)
    shown = current_generation(spark, table)
    expected = [(field.name, field.dataType.simpleString()) for field in schema]
    if shown is None or _columns(spark, table) != expected:
        _replace_entry(spark, table, path, schema, shown is not None, mark or uuid4().hex[:12])
    elif shown == generation:
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"ALTER TABLE {table} SET LOCATION :path", args={"path": path})
    if spark.catalog.getTable(table).description != comment:
        spark.sql(f"COMMENT ON TABLE {table} IS :comment", args={"comment": comment})
