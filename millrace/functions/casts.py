"""Column conversions: tolerant, strict, and the two composed into a field list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One output column: its name, its type and what unreadable input does.

    A tolerant field turns input it cannot read into NULL. A strict field fails
    the job under ANSI rules.
    """

    name: str
    data_type: str
    tolerant: bool = False

    def read(self) -> Column:
        source = F.col(self.name)
        converted = source.try_cast(self.data_type) if self.tolerant else source.cast(self.data_type)
        return converted.alias(self.name)
