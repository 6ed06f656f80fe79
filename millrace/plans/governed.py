"""A full refresh that runs only when requested, only once, and never unrecorded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    COMPLETED,
    FAIL,
    FAILED,
    LEDGER_SCHEMA,
    OUTCOME_UNKNOWN,
    SKIP,
    TRIGGERING,
    append_attempt,
    blocked_keys,
    ledger_breaks,
    refresh_decision,
    refresh_unblocked,
    release_tags,
    seals,
    tampered,
)
from ..sources import scan

# Fixed value: returned when an earlier attempt rules out another one.
BLOCKED = "BLOCKED"


def take_claim(spark: SparkSession, ledger: str, pipeline_key: str, release: str, before: int, attempt: str) -> bool:
    """Whether this attempt is the one that may follow ``before`` others of the same pipeline and release."""
    key = hashlib.sha256(json.dumps([pipeline_key, release]).encode()).hexdigest()
    return seals(spark, ledger).take(f"claims/{key}/{before:06d}", attempt)


class AmbiguousRequest(Exception):
    """A tag has several requests; none of them is picked."""


class LedgerTampered(Exception):
    """Records of the ledger were altered, taken away or put in, so what ran is undecidable."""


def governed_refresh(
    spark: SparkSession,
    tag: str,
    requests: DataFrame,
    ledger: str,
    refreshers: Mapping[str, Callable[[], str]],
    tagger: str,
    approver: str | None = None,
    run_link: str | None = None,
) -> str:
    """Carry out the full refresh a release tag asks for, and return the outcome.

    ``refreshers`` maps a pipeline key to a function that refreshes it to the end
    and returns an id of that update. The claim is on record before the function
    is called and the outcome after it, whatever happens. Failures are raised
    again. Of runs for one release that start together one gets the claim, by creating a file
    that can be created once, and the others are blocked. Each attempt that may follow a failed one has a claim of its own. A
    claim whose run ended before it was on record blocks too: what that run did is not known.
    """
    tags = release_tags(spark.createDataFrame([(tag,)], "tag STRING"))
    asked = requests.filter(F.col("release_version") == tag)
    decided = refresh_decision(tags, asked).first()
    if decided is None or decided["decision"] == SKIP:
        return SKIP
    if decided["decision"] == FAIL:
        raise AmbiguousRequest(f"{decided['n_requests']} refresh requests for tag {tag}")

    request = asked.first()
    if request["pipeline_key"] is None:
        raise ValueError(f"the refresh request for tag {tag} names no pipeline")
    before = 0  # attempts on record
    if spark.catalog.tableExists(ledger):
        # All of it is checked: a row whose key was altered is no longer found by its key.
        record = scan(spark, ledger, fresh=True)
        altered = tampered(record).select("attempt_id", "seq").take(1)
        if altered:
            raise LedgerTampered(f"{ledger}, for one at {tuple(altered[0])}")
        broken = ledger_breaks(spark, ledger).take(1)
        if broken:
            raise LedgerTampered(f"{ledger}: {broken[0].problem}, position {broken[0].position} of chain {broken[0].chain}")
        record = record.filter(
            (F.col("release_version") == tag) & (F.col("pipeline_key") == request["pipeline_key"])
        )
        if refresh_unblocked(asked, blocked_keys(record)).isEmpty():
            return BLOCKED
        before = record.select("attempt_id").distinct().count()

    attempt = uuid4().hex
    if not take_claim(spark, ledger, request["pipeline_key"], tag, before, attempt):
        return BLOCKED

    def put_on_record(seq: int, outcome: str, update_id: str | None) -> None:
        row = (
            attempt,
            seq,
            request["pipeline_key"],
            tag,
            request["reason"],
            tagger,
            approver,
            update_id,
            run_link,
            outcome,
        )
        append_attempt(spark.createDataFrame([row], LEDGER_SCHEMA), ledger)

    put_on_record(1, TRIGGERING, None)
    # Anything that is not an ordinary error cut the run short from outside.
    outcome, update_id = OUTCOME_UNKNOWN, None
    try:
        update_id = refreshers[request["pipeline_key"]]()
        outcome = COMPLETED
    except Exception:
        outcome = FAILED
        raise
    finally:
        put_on_record(2, outcome, update_id)
    return outcome


__all__ = ["BLOCKED", "AmbiguousRequest", "LedgerTampered", "governed_refresh"]
