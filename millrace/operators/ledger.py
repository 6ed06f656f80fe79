"""The append-only record of refresh attempts: one row for the claim, one for the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import record_hash
from ..sources.tables import scan
from .chain import CHAIN_SCHEMA, altered, chain_breaks, chain_of, chained, ends, extend, kept_heads, seals
from .requests import REFRESH_KEY, blocks

# Fixed value: what is recorded when nobody is known to have approved.
NO_APPROVER = "unknown (no pull request found)"

LEDGER_FIELDS = [
    "attempt_id",
    "seq",
    "pipeline_key",
    "release_version",
    "reason",
    "tagger",
    "approver",
    "update_id",
    "run_link",
    "outcome",
]
LEDGER_SCHEMA = ", ".join(f"{name} {'INT' if name == 'seq' else 'STRING'}" for name in LEDGER_FIELDS)


def with_approver_default(ledger: DataFrame) -> DataFrame:
    """A missing approver is put on record as such; it does not stop the refresh."""
    return ledger.withColumn("approver", F.coalesce("approver", F.lit(NO_APPROVER)))


def with_integrity(ledger: DataFrame) -> DataFrame:
    """Add the hash of all recorded fields.

    Attempt and position are hashed too: renumbering rows, or moving an outcome
    to another attempt, would change the current outcome just as an edit does.
    """
    return ledger.withColumn("integrity", record_hash(LEDGER_FIELDS))


def tampered(ledger: DataFrame) -> DataFrame:
    """Rows whose stored hash is missing or is not the hash of their fields."""
    return altered(ledger, LEDGER_FIELDS)


def current_outcomes(ledger: DataFrame) -> DataFrame:
    """The outcome on the latest row of every attempt.

    Should two rows claim to be the latest, the one that blocks wins. A row without a
    position could be the latest one, so its attempt has no known outcome: NULL, which blocks.
    """
    latest = F.max(F.struct("seq", blocks(F.col("outcome")).alias("blocking"), "outcome"))
    return (
        ledger.groupBy("attempt_id", *REFRESH_KEY)
        .agg(latest.alias("latest"), F.count_if(F.col("seq").isNull()).alias("unplaced"))
        .select("attempt_id", *REFRESH_KEY, F.when(F.col("unplaced") == 0, F.col("latest.outcome")).alias("outcome"))
    )


def blocked_keys(ledger: DataFrame) -> DataFrame:
    """The (pipeline, release) pairs that the current outcome of some attempt blocks.

    The same rules as in ``current_outcomes``. Position and blocking fit one number, whose
    maximum is aggregated by hash; text in the buffer would need sorting.
    """
    blocking = blocks(F.col("outcome")).cast("long")
    latest = F.max(2 * F.col("seq").cast("long") + blocking)
    return (
        ledger.groupBy("attempt_id", *REFRESH_KEY)
        .agg(latest.alias("latest"), F.count_if(F.col("seq").isNull()).alias("unplaced"))
        .filter((F.col("unplaced") > 0) | (F.pmod(F.col("latest"), F.lit(2)) == 1))
        .select(*REFRESH_KEY)
        .distinct()
    )


def chain_table(ledger: str) -> str:
    """The table of the chain that covers a ledger."""
    return f"{ledger}_chain"


def append_attempt(rows: DataFrame, table: str) -> None:
    """Add rows to the ledger table with approver, hash and place in the chain. Nothing is replaced.

    The head moves first and the record comes last: a run that is cut off in between leaves a head without its
    record, which stops further runs until somebody has looked.
    """
    spark = rows.sparkSession
    sealed = with_integrity(with_approver_default(rows)).select(*LEDGER_FIELDS, "integrity", chain_of().alias("chain"))
    new = sealed.orderBy("attempt_id", "seq").collect()  # what one call adds: a row, or a few by hand
    files = seals(spark, table)
    entries = [(r.chain, *(place := extend(files, r.chain, r.integrity))[:1], r.attempt_id, r.seq, r.integrity, place[1]) for r in new]
    chain = spark.createDataFrame(entries, CHAIN_SCHEMA).coalesce(1)
    chain.write.mode("append").format("parquet").saveAsTable(chain_table(table))
    records = spark.createDataFrame([tuple(r)[:-1] for r in new], f"{LEDGER_SCHEMA}, integrity STRING").coalesce(1)
    records.write.mode("append").format("parquet").saveAsTable(table)


def ledger_breaks(spark: SparkSession, ledger: str) -> DataFrame:
    """Where a ledger table, its chain and its heads disagree; see ``chain_breaks``. A ledger without a chain is one break per record."""
    record = scan(spark, ledger, fresh=True)
    table = chain_table(ledger)
    chain = scan(spark, table, fresh=True) if spark.catalog.tableExists(table) else spark.createDataFrame([], CHAIN_SCHEMA)
    return chain_breaks(record, chain, kept_heads(spark, ledger))


def seal_ledger(spark: SparkSession, ledger: str) -> None:
    """Start a chain for a ledger that has none, as one written before there were chains.

    A ledger that has a chain or heads is refused: whoever wants to begin anew has to take both away first.
    """
    files = seals(spark, ledger)
    if spark.catalog.tableExists(chain_table(ledger)) or files.names("heads"):
        raise ValueError(f"{ledger} has a chain already")
    chained(scan(spark, ledger, fresh=True)).write.format("parquet").saveAsTable(chain_table(ledger))
    for row in ends(scan(spark, chain_table(ledger))).collect():  # one per pipeline
        files.take(f"heads/{row.chain}/{row.position:012d}", row.link)
