"""Which releases ask for a full refresh, and which of those may run.

All jobs work on whole tables of tags, requests and attempts. Every side is
reduced to one row per key before it meets another, so a key that holds a large
part of a table is counted where it lies instead of being sent to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_release

# Decisions and recorded outcomes.
SKIP, RUN, FAIL = "SKIP", "RUN", "FAIL"
TRIGGERING = "TRIGGERING"
COMPLETED = "COMPLETED"
FAILED = "FAILED"
OUTCOME_UNKNOWN = "OUTCOME UNKNOWN"

REFRESH_KEY = ["pipeline_key", "release_version"]


def blocks(outcome: Column) -> Column:
    """Whether an attempt with this outcome rules out another one.

    Only the two outcomes known to permit a retry do not. A missing or unknown
    label blocks, because it leaves open whether the refresh took place.
    """
    return ~F.coalesce(outcome.isin(FAILED, OUTCOME_UNKNOWN), F.lit(False))


def release_tags(tags: DataFrame) -> DataFrame:
    """Tags that name a release, each once."""
    return tags.filter(is_release(F.col("tag"))).select("tag").distinct()


def _requests_per_tag(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.col("release_version").alias("tag")).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.min(F.struct("pipeline_key", "reason")).alias("request"),
    )


def refresh_decision(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """For each tag: no request skips, exactly one runs, several fail."""
    per_tag = requests.groupBy(F.col("release_version").alias("tag")).agg(
        F.count(F.lit(1)).alias("n_requests")
    )
    n_requests = F.coalesce("n_requests", F.lit(0).cast("long"))
    decision = F.when(n_requests == 0, SKIP).when(n_requests == 1, RUN).otherwise(FAIL)
    return (
        tags.select("tag")
        .distinct()
        .join(per_tag, "tag", "left")
        .select("tag", n_requests.alias("n_requests"), decision.alias("decision"))
    )


def requested_refreshes(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """The one request of every tag that decides to run."""
    return (
        tags.select("tag")
        .distinct()
        .join(_requests_per_tag(requests).filter("n_requests = 1"), "tag")
        .select("request.pipeline_key", F.col("tag").alias("release_version"), "request.reason")
    )


def refresh_eligible(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requested (pipeline, release) pairs that no attempt blocks.

    ``current`` has one row per attempt, as ``current_outcomes`` gives it. A
    request without a pipeline or release names nothing to run and is left out.
    """
    blocked = current.filter(blocks(F.col("outcome"))).select(*REFRESH_KEY).distinct()
    return refresh_unblocked(requests, blocked)


def refresh_unblocked(requests: DataFrame, blocked: DataFrame) -> DataFrame:
    """Requested pairs that are not among the blocked ones."""
    asked = requests.select(*REFRESH_KEY).dropna().distinct()
    return asked.join(blocked, REFRESH_KEY, "left_anti")
