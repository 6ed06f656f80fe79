"""A pipeline: tables written one after the other, each from those before it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

from ..operators import VALID_ORDER_ID, Expectation, broken_rows, contract, expect_and_count, require_contract, transform_orders
from ..session import require_settings
from ..sources import scan, scan_new_files
from ..streaming import Counts, append, counted, start_counting
from .generations import Generation, current_generation, new_generation, show
from .journal import Shown, move_tables, settle
from .order import UnknownTable, in_order

Read = Callable[[str], DataFrame]


class NotUpdatable(Exception):
    """The table shown cannot be brought up to date, only replaced."""


@dataclass(frozen=True)
class Step:
    """One table of a pipeline and the rows it holds.

    ``build`` gets a function that reads another table of the same pipeline
    by name, as a batch or as a stream depending on how the pipeline is run. It is called
    twice, first only to learn what it reads, so it should do nothing but describe its rows. ``broken`` names a second
    table, in the same database, for the rows that fail an expectation: with it every row offered is in one of both.
    """

    table: str
    build: Callable[[Read], DataFrame]
    expectations: tuple[Expectation, ...] = ()
    comment: str = ""
    broken: str | None = None


@dataclass(frozen=True)
class Update:
    """What one run of a pipeline did: the generation written to, and row counts."""

    generation: str
    counts: Mapping[str, Counts]


def orders_pipeline(rows: Callable[[], DataFrame], raw: str, bronze: str) -> tuple[Step, Step]:
    """Raw orders as they come, and cleaned orders with an id."""
    return (
        Step(raw, lambda read: rows(), comment="Orders as they arrived, nothing converted."),
        Step(
            bronze,
            lambda read: require_contract(transform_orders(read(raw)), contract()),
            (VALID_ORDER_ID,),
            "Orders with typed columns; rows without an id are dropped.",
        ),
    )


def _ready(spark: SparkSession, steps: Sequence[Step], streamed: bool) -> list[Step]:
    """The steps in the order of what they read, after refusing what would only fail, or do harm, when all work is done."""
    require_settings(spark)
    if not steps:
        raise ValueError("a pipeline has one step at least")
    tables = [table for step in steps for table in (step.table, step.broken) if table is not None]
    if len(set(tables)) != len(tables):
        raise ValueError(f"two steps write one table: {sorted(t for t in set(tables) if tables.count(t) > 1)}")
    for table in tables:
        settle(spark, table)  # whichever of them the pipeline is named by
    for table in tables:
        current_generation(spark, table)

    def elsewhere(table: str) -> DataFrame:
        if streamed or not spark.catalog.tableExists(table):
            raise UnknownTable(f"{table}: no step writes it" + (", and updates read no other tables" if streamed else ", and there is no such table"))
        return scan(spark, table)

    return in_order(steps, elsewhere)


def recompute(spark: SparkSession, steps: Sequence[Step]) -> Update:
    """Batch update: write every table anew and show them when all are complete.

    Steps may come in any order: a step reads the tables that this run writes as this run writes them. A table that
    no step writes, and a step's own, are read as they are shown. A step that fails leaves every table
    as it was. The counts come from the writing jobs themselves.
    """
    steps = _ready(spark, steps, streamed=False)
    generation = new_generation(spark, steps[-1].table, streamed=False)
    counts, schemas = {}, {}

    def read(table: str) -> DataFrame:
        if table not in schemas:  # not of this run, so as it is shown
            return scan(spark, table)
        return spark.read.schema(schemas[table]).parquet(generation.data(table))

    for step in steps:
        rows = step.build(read)
        schemas[step.table] = rows.schema
        observed = Observation()
        counted = expect_and_count(rows, observed, step.expectations)
        counted.write.parquet(generation.data(step.table))
        counts[step.table] = Counts.of(observed.get)
        if step.broken:
            rest = broken_rows(rows, step.expectations)
            schemas[step.broken] = rest.schema
            rest.write.parquet(generation.data(step.broken))
    move_tables(spark, _shown(steps, schemas), generation)
    return Update(generation.id, counts)


def _append_to(
    spark: SparkSession, steps: Sequence[Step], generation: Generation, shown: bool
) -> Update:
    """Bring every table of one generation up to date, in order.

    Steps read earlier tables of the same generation and never another's. A
    checkpoint therefore always belongs to the files it was made from. Tables of
    a generation that is shown already are kept current step by step; a new one
    is shown only when all its tables are complete. Rows are counted while later tables are written.
    """
    schemas, countings = {}, {}

    def read(table: str) -> DataFrame:
        return scan_new_files(spark, generation.data(table), schemas[table])

    try:
        for step in steps:
            rows = step.build(read)
            schemas[step.table] = rows.schema
            target = generation.data(step.table), generation.checkpoint(step.table)
            append(rows, *target, step.expectations)
            if step.broken:
                # A stream of its own over the same rows: each of both tables gets every row of its kind once, after a cut-off run too.
                rest = broken_rows(rows, step.expectations)
                schemas[step.broken] = rest.schema
                append(rest, generation.data(step.broken), generation.checkpoint(step.broken))
            countings[step.table] = start_counting(rows, *target, step.expectations)
            if shown:
                for to in _shown([step], schemas):
                    show(spark, to.table, generation, to.schema, to.comment)
        counts = {table: counted(query, spark, generation.checkpoint(table)) for table, query in countings.items()}
    finally:
        for query in countings.values():
            query.stop()
    if not shown:
        move_tables(spark, _shown(steps, schemas), generation)
    return Update(generation.id, counts)


def _shown(steps: Sequence[Step], schemas: Mapping[str, StructType]) -> list[Shown]:
    """The tables of the steps in the order in which they are shown, the last step's own last."""
    tables = []
    for step in steps:
        if step.broken:
            tables.append(Shown(step.broken, schemas[step.broken], f"Rows that {step.table} leaves out, with what they fail."))
        tables.append(Shown(step.table, schemas[step.table], step.comment))
    return tables


def update(spark: SparkSession, steps: Sequence[Step]) -> Update:
    """Incremental update: clean and append only input that has arrived since the last one.

    The last table is shown last, so its generation is the pipeline's. A refresh that stopped while it
    moved the tables is settled first, so all of them are at the same one.
    Tables that a batch wrote have no checkpoint to go on from. Replacing them has to
    be asked for, so that is an error; only a pipeline without a table starts by itself.
    """
    steps = _ready(spark, steps, streamed=True)
    generation = current_generation(spark, steps[-1].table)
    if generation is None:
        return full_refresh(spark, steps)
    if not generation.streamed:
        raise NotUpdatable(f"{steps[-1].table} was written by a batch; full_refresh replaces it")
    return _append_to(spark, steps, generation, shown=True)


def full_refresh(spark: SparkSession, steps: Sequence[Step]) -> Update:
    """Read all input again into a new generation and show that instead of the old one.

    Data and checkpoints are new together. With only one of them new, the run
    would add nothing, or would leave the table empty.
    """
    steps = _ready(spark, steps, streamed=True)
    generation = new_generation(spark, steps[-1].table, streamed=True)
    return _append_to(spark, steps, generation, shown=False)
