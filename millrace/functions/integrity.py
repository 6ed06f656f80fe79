"""Hash of a record's fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_hash(fields: Iterable[str]) -> Column:
    """SHA-256 over the named fields as one JSON object, in the order given.

    JSON keeps the field boundaries and writes NULL fields out, so moving text
    from one field to the next, or emptying a field, changes the hash.
    """
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.sha2(record, 256)
