"""Predicates on release names."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed value: three dot-separated groups of ASCII digits and nothing else.
# \z rather than $, which would also accept a trailing line break.
RELEASE_SHAPE = r"\A[0-9]+[.][0-9]+[.][0-9]+\z"


def is_release(tag: Column) -> Column:
    return tag.rlike(RELEASE_SHAPE)
