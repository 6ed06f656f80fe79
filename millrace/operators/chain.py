"""A hash chain over the records of each pipeline, with its head kept apart.

Every entry's link covers its record's hash and the link before it, so a record that is taken
away, put in or moved breaks the chain at its place, and the head tells whether the end is still there.
The chain is a table beside the ledger, the heads are files that can be created only once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import record_hash
from ..sources.exclusive import Taken

CHAIN_FIELDS = ["chain", "position", "attempt_id", "seq", "integrity", "link"]
CHAIN_SCHEMA = "chain STRING, position LONG, attempt_id STRING, seq INT, integrity STRING, link STRING"
HEAD_SCHEMA = "chain STRING, position LONG, link STRING"

# What is wrong at a place of a chain.
NO_RECORD = "the ledger has no such record"
NO_ENTRY = "the chain has no such entry"
NOT_LINKED = "does not follow the entry before"
NOT_THE_END = "is not where the chain ends"


def chain_of(pipeline_key: str | Column = "pipeline_key") -> Column:
    """The name of a pipeline's chain, which is also what its first link covers. NULL has one too."""
    key = F.col(pipeline_key) if isinstance(pipeline_key, str) else pipeline_key
    return F.sha2(F.to_json(F.struct(key.alias("pipeline_key")), {"ignoreNullFields": "false"}), 256)


def _next_link(before: Column, integrity: Column) -> Column:
    return F.sha2(F.concat(before, F.coalesce(integrity, F.lit(""))), 256)


def _packed(text: Column) -> Column:
    """Text as bytes that tell every text apart; lower-case hexadecimal, as of hashes, takes half, for shuffles."""
    raw = F.unhex(text)
    is_hex = F.coalesce(F.lower(F.hex(raw)) == text, F.lit(False))
    return F.when(is_hex, F.concat(F.unhex(F.lit("00")), raw)).otherwise(F.concat(F.unhex(F.lit("01")), text.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, 1 << 30)
    return F.when(F.substring(packed, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def chained(sealed: DataFrame) -> DataFrame:
    """The chain entries of a sealed ledger, each pipeline's records by attempt and position.

    A chain is sequential, so one pipeline's entries are linked in one task; it has some rows per release.
    """
    rows = sealed.withColumn("chain", chain_of()).groupBy("chain").agg(
        F.sort_array(F.collect_list(F.struct("attempt_id", "seq", "integrity"))).alias("rows")
    )
    entry = "struct<attempt_id:string,seq:int,integrity:string,link:string>"
    start = F.struct(F.col("chain").alias("link"), F.array().cast(f"array<{entry}>").alias("done"))

    def follow(state: Column, row: Column) -> Column:
        link = _next_link(state["link"], row["integrity"])
        made = F.struct(row["attempt_id"], row["seq"], row["integrity"], link).cast(entry)
        return F.struct(link.alias("link"), F.concat(state["done"], F.array(made)).alias("done"))

    linked = rows.select("chain", F.aggregate("rows", start, follow, lambda state: state["done"]).alias("done"))
    return linked.select("chain", F.posexplode("done").alias("at", "e")).select(
        "chain", (F.col("at") + 1).cast("long").alias("position"), "e.*"
    )


def ends(chain: DataFrame) -> DataFrame:
    """The last entry of every chain."""
    last = F.max(F.struct("position", "link")).alias("last")
    return chain.groupBy("chain").agg(last).select("chain", "last.position", "last.link")


def chain_breaks(ledger: DataFrame, chain: DataFrame, heads: DataFrame) -> DataFrame:
    """Where ledger, chain and heads disagree: ``chain``, ``position``, ``attempt_id``, ``seq`` and ``problem``.

    No rows mean that every record is there, unaltered, in its order, and nothing else. Records and entries meet in one
    aggregation and entries meet the one before by an equality of chain and position, so a long
    chain is not a single task. Repeated records need as many entries. ``position`` is null for a record without an entry.
    Hashes are shuffled as bytes.
    """
    record = ["chain", "attempt_id", "seq", "integrity"]
    ours = ledger.select(chain_of().alias("chain"), "attempt_id", "seq", "integrity", F.lit(None).cast("long").alias("position"))
    both = ours.withColumn("n", F.lit(1)).unionByName(chain.select(*record, "position").withColumn("n", F.lit(-1)))
    both = both.withColumns({name: _packed(F.col(name)) for name in ("chain", "integrity")})
    counted = both.groupBy(*record).agg(F.sum("n").alias("n"), F.min("position").alias("position"))
    uneven = counted.filter("n <> 0").select(
        _unpacked(F.col("chain")).alias("chain"),
        F.when(F.col("n") < 0, F.col("position")).alias("position"),
        "attempt_id",
        "seq",
        F.when(F.col("n") < 0, NO_RECORD).otherwise(NO_ENTRY).alias("problem"),
    )
    before = chain.select(F.col("chain").alias("_chain"), (F.col("position") + 1).alias("_position"), F.col("link").alias("_link"))
    first = heads.select("chain").union(chain.select("chain")).distinct()
    before = before.unionByName(first.select(F.col("chain").alias("_chain"), F.lit(1).cast("long").alias("_position"), F.col("chain").alias("_link")))
    before = before.withColumns({name: _packed(F.col(name)) for name in ("_chain", "_link")})
    entries = chain.withColumns({name: _packed(F.col(name)) for name in ("chain", "integrity", "link")})
    at = (F.col("chain") == F.col("_chain")) & (F.col("position") == F.col("_position"))
    next_link = _next_link(_unpacked(F.col("_link")), _unpacked(F.col("integrity")))
    follows = F.coalesce(_unpacked(F.col("link")) == next_link, F.lit(False))
    unlinked = entries.join(before, at, "left").groupBy("chain", "position", "attempt_id", "seq").agg(
        F.count("*").alias("n"), F.bool_and(follows).alias("follows")
    )
    unlinked = unlinked.filter("n > 1 OR NOT follows").select(_unpacked(F.col("chain")).alias("chain"), "position", "attempt_id", "seq", F.lit(NOT_LINKED).alias("problem"))
    shown = ends(chain).select(F.col("chain").alias("_chain"), F.col("position").alias("_position"), F.col("link").alias("_link"))
    kept = heads.select(F.col("chain"), F.col("position"), F.col("link"))
    same = F.col("position").eqNullSafe(F.col("_position")) & F.col("link").eqNullSafe(F.col("_link"))
    ended = kept.join(shown, F.col("chain") == F.col("_chain"), "full").filter(~same).select(
        F.coalesce("chain", "_chain").alias("chain"),
        F.coalesce("position", "_position").alias("position"),
        F.lit(None).cast("string").alias("attempt_id"),
        F.lit(None).cast("int").alias("seq"),
        F.lit(NOT_THE_END).alias("problem"),
    )
    return uneven.unionByName(unlinked).unionByName(ended)


def altered(ledger: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose stored hash is missing or is not the hash of their fields."""
    return ledger.filter(~F.col("integrity").eqNullSafe(record_hash(fields)))


def seals(spark: SparkSession, ledger: str) -> Taken:
    """The folder of a ledger's heads and claims, beside its database's tables."""
    database, _, name = ledger.rpartition(".")
    folder = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri.rstrip("/")
    return Taken(spark, f"{folder}/seals/{name}")


def kept_heads(spark: SparkSession, ledger: str) -> DataFrame:
    """The head of every chain, one row per pipeline."""
    files = seals(spark, ledger)
    rows = []
    for chain in files.names("heads"):
        last = files.names(f"heads/{chain}")[-1]
        rows.append((chain, int(last), files.text(f"heads/{chain}/{last}")))
    return spark.createDataFrame(rows, HEAD_SCHEMA)


def extend(files: Taken, chain: str, integrity: str) -> tuple[int, str]:
    """Move the head on by one record and return its position and link. Of several that try at once each gets a place."""
    while True:
        names = files.names(f"heads/{chain}")
        last = int(names[-1]) if names else 0
        before = files.text(f"heads/{chain}/{names[-1]}") if names else chain
        link = hashlib.sha256(f"{before}{integrity}".encode()).hexdigest()
        if files.take(f"heads/{chain}/{last + 1:012d}", link):
            return last + 1, link
