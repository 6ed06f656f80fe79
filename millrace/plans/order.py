"""The order in which the tables of a pipeline have to be written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from graphlib import CycleError, TopologicalSorter
from typing import Protocol

from pyspark.sql import DataFrame


class Built(Protocol):
    table: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]


class UnknownTable(Exception):
    """A step reads a table that no step writes and that is not there otherwise."""


class CircularTables(Exception):
    """Tables that are each made from the other."""


def reads(steps: Sequence[Built], elsewhere: Callable[[str], DataFrame]) -> dict[str, set[str]]:
    """For each table the tables of the same pipeline that it is made from.

    Every step is built once without running anything; what its ``build`` asks for are its sources. A step is
    given another's rows as that one builds them, and a table that no step writes as ``elsewhere`` gives it.
    A table that reads itself gets its old rows from ``elsewhere`` too.
    """
    by_table = {}
    for step in steps:
        if step.table in by_table:
            raise ValueError(f"two steps write {step.table}")
        by_table[step.table] = step
    found: dict[str, set[str]] = {}
    rows: dict[str, DataFrame] = {}
    under_way: list[str] = []

    def built(table: str) -> DataFrame:
        if table in under_way:
            raise CircularTables(" <- ".join([*under_way[under_way.index(table) :], table]))
        if table not in rows:
            under_way.append(table)
            found[table] = set()

            def read(name: str) -> DataFrame:
                if name == table or name not in by_table:
                    return elsewhere(name)
                found[table].add(name)
                return built(name)

            rows[table] = by_table[table].build(read)
            under_way.pop()
        return rows[table]

    for table in by_table:
        built(table)
    return found


def in_order(steps: Sequence[Built], elsewhere: Callable[[str], DataFrame]) -> list[Built]:
    """The steps, each after those it reads. The order depends on names and reads alone, not on that given."""
    sources = reads(steps, elsewhere)
    sorter = TopologicalSorter(sources)
    try:
        sorter.prepare()
    except CycleError as error:
        raise CircularTables(" <- ".join(error.args[1])) from None
    order = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        order += ready
        sorter.done(*ready)
    by_table = {step.table: step for step in steps}
    return [by_table[table] for table in order]
