"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and within whatever lambda it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_at_most(values: Column, bound: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    """The last of ``values``, which rise by ``of``, with ``of`` at most ``bound``: 24 looks in 16 million values.

    If there is none, it is the first of them, and null of an empty array. ``values`` must be a column or a lambda's variable.
    """
    steps = F.array(*(F.lit(1 << n) for n in reversed(range(24))))

    def step(place: Column, width: Column) -> Column:
        return F.when(of(F.get(values, place + width)) <= bound, place + width).otherwise(place)

    within = F.filter(steps, lambda width: width < F.size(values))
    return F.get(values, F.aggregate(within, F.lit(0), step))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def same(left, right, *names: str) -> Column:
    """Join condition on columns of the same names, nulls being equal."""
    return reduce(Column.__and__, (left[n].eqNullSafe(right[n]) for n in names))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in either case of letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
