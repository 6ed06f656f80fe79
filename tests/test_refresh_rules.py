from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import (
    LEDGER_FIELDS,
    LEDGER_SCHEMA,
    NO_APPROVER,
    append_attempt,
    current_outcomes,
    refresh_decision,
    refresh_eligible,
    release_tags,
    requested_refreshes,
    tampered,
    with_approver_default,
    with_integrity,
)

REQUESTS = "pipeline_key STRING, release_version STRING, reason STRING"
CURRENT = "attempt_id STRING, pipeline_key STRING, release_version STRING, outcome STRING"
QUIET = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def tags(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "tag STRING")


def test_release_tags(spark):
    good = ["1.0.1", "2.14.0", "0.0.0", "10.200.3000", "01.2.3"]
    bad = ["v1.0.1", "1.0", "1.0.1.2", "1.0.1-rc1", " 1.0.1", "1.0.1\n", "1.0.1 ", "a.b.c", "", "1..2", "١.٢.٣", None]
    found = release_tags(tags(spark, *good, *bad, *good))
    assert sorted(r["tag"] for r in found.collect()) == sorted(good)


def test_decision_by_number_of_requests(spark):
    requests = spark.createDataFrame(
        [
            ("p", "1.0.1", "once"),
            ("p", "1.0.2", "one pipeline"),
            ("q", "1.0.2", "another"),
            ("p", "1.0.3", "the same"),
            ("p", "1.0.3", "the same"),
            ("p", None, "no release"),
            ("p", "9.9.9", "no such tag"),
        ],
        REQUESTS,
    )
    asked = tags(spark, "1.0.0", "1.0.1", "1.0.1", "1.0.2", "1.0.3")
    rows = refresh_decision(asked, requests).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("1.0.0", 0, "SKIP"),
        ("1.0.1", 1, "RUN"),
        ("1.0.2", 2, "FAIL"),
        ("1.0.3", 2, "FAIL"),
    ]
    assert [tuple(r) for r in requested_refreshes(asked, requests).collect()] == [("p", "1.0.1", "once")]


@pytest.mark.parametrize(
    ("outcomes", "eligible"),
    [
        ([], True),
        (["FAILED"], True),
        (["OUTCOME UNKNOWN"], True),
        (["FAILED", "OUTCOME UNKNOWN", "FAILED"], True),
        (["COMPLETED"], False),
        (["TRIGGERING"], False),
        (["FAILED", "COMPLETED"], False),
        ([None], False),
        (["FAILED", None], False),
        (["failed"], False),
        (["FAILED "], False),
        (["something else"], False),
    ],
)
def test_eligibility_fails_closed(spark, outcomes, eligible):
    requests = spark.createDataFrame([("p", "1.0.1", "r"), ("p", "1.0.1", "again")], REQUESTS)
    rows = [(str(i), "p", "1.0.1", outcome) for i, outcome in enumerate(outcomes)]
    rows += [("x", "q", "1.0.1", "COMPLETED"), ("y", "p", "1.0.2", "COMPLETED")]
    found = refresh_eligible(requests, spark.createDataFrame(rows, CURRENT)).collect()
    assert [tuple(r) for r in found] == ([("p", "1.0.1")] if eligible else [])


def test_requests_that_name_nothing_are_not_eligible(spark):
    requests = spark.createDataFrame([(None, "1.0.1", "r"), ("p", None, "r")], REQUESTS)
    assert refresh_eligible(requests, spark.createDataFrame([], CURRENT)).isEmpty()


OUTCOMES = st.sampled_from(["FAILED", "OUTCOME UNKNOWN", "COMPLETED", "TRIGGERING", "odd", None])
KEYS = st.tuples(st.sampled_from("pqr"), st.sampled_from(["1.0.0", "1.0.1"]))


@QUIET
@given(
    st.lists(KEYS, max_size=8),
    st.lists(st.tuples(st.integers(0, 6), KEYS, st.integers(1, 4), OUTCOMES), max_size=20),
    st.lists(st.sampled_from(["1.0.0", "1.0.1", "1.0.2"]), max_size=4),
)
def test_rules_agree_with_plain_python(spark, asked, attempts, names):
    """Decision, latest outcome and eligibility against loops over lists."""
    requests = spark.createDataFrame([(p, r, "why") for p, r in asked], REQUESTS)
    ledger = spark.createDataFrame(
        [(f"{p}{r}{a}", s, p, r, None, None, None, None, None, o) for a, (p, r), s, o in attempts],
        LEDGER_SCHEMA,
    )

    per_tag = Counter(r for _, r in asked)
    decided = {r["tag"]: r["decision"] for r in refresh_decision(tags(spark, *names), requests).collect()}
    assert decided == {n: ("SKIP", "RUN")[per_tag[n]] if per_tag[n] < 2 else "FAIL" for n in names}

    retry = {"FAILED", "OUTCOME UNKNOWN"}
    latest = {}
    for a, key, s, o in attempts:
        rank = (s, o not in retry, o is not None, o or "")
        latest[a, key] = max(latest.get((a, key), (rank, o)), (rank, o), key=lambda pair: pair[0])
    current = current_outcomes(ledger)
    found = {(r["attempt_id"], r["pipeline_key"], r["release_version"]): r["outcome"] for r in current.collect()}
    assert found == {(f"{p}{r}{a}", p, r): o for (a, (p, r)), (_, o) in latest.items()}

    blocked = {key for (_, key), (_, o) in latest.items() if o not in retry}
    eligible = [tuple(r) for r in refresh_eligible(requests, current).collect()]
    assert sorted(eligible) == sorted(set(asked) - blocked)


def test_the_claim_of_a_failed_attempt_does_not_block(spark):
    claim = ("a", 1, "p", "1.0.1", "r", "t", None, None, None, "TRIGGERING")
    failed = ("a", 2, "p", "1.0.1", "r", "t", None, None, None, "FAILED")
    requests = spark.createDataFrame([("p", "1.0.1", "r")], REQUESTS)
    claimed = spark.createDataFrame([claim], LEDGER_SCHEMA)
    assert refresh_eligible(requests, current_outcomes(claimed)).isEmpty()
    ended = spark.createDataFrame([claim, failed], LEDGER_SCHEMA)
    assert refresh_eligible(requests, current_outcomes(ended)).count() == 1


ROW = ("a", 1, "p", "1.0.1", "say \"hi\"\n", "t", "boss", "u", "http://x", "COMPLETED")


@pytest.mark.parametrize("name", LEDGER_FIELDS)
@pytest.mark.parametrize("kind", ["changed", "emptied"])
def test_any_altered_field_is_detected(spark, name, kind):
    sealed = with_integrity(spark.createDataFrame([ROW], LEDGER_SCHEMA))
    assert tampered(sealed).isEmpty()
    value = F.lit(None) if kind == "emptied" else F.lit(2 if name == "seq" else "other")
    altered = sealed.withColumn(name, value.cast("int" if name == "seq" else "string"))
    assert tampered(altered).count() == 1


def test_a_missing_or_moved_value_is_detected(spark):
    sealed = with_integrity(spark.createDataFrame([ROW], LEDGER_SCHEMA))
    assert tampered(sealed.withColumn("integrity", F.lit(None).cast("string"))).count() == 1
    swapped = sealed.withColumns({"reason": F.col("tagger"), "tagger": F.col("reason")})
    assert tampered(swapped).count() == 1


def test_missing_approver_is_put_on_record(spark):
    rows = [ROW, ROW[:6] + (None,) + ROW[7:]]
    found = with_approver_default(spark.createDataFrame(rows, LEDGER_SCHEMA)).collect()
    assert [r["approver"] for r in found] == ["boss", NO_APPROVER]


def test_attempts_are_added_and_sealed(spark, database):
    ledger = f"{database}.ledger"
    no_approver = ROW[:6] + (None,) + ROW[7:]
    append_attempt(spark.createDataFrame([ROW], LEDGER_SCHEMA), ledger)
    append_attempt(spark.createDataFrame([no_approver], LEDGER_SCHEMA), ledger)
    rows = spark.table(ledger)
    assert rows.columns == [*LEDGER_FIELDS, "integrity"]
    assert sorted(r["approver"] for r in rows.collect()) == ["boss", NO_APPROVER]
    assert tampered(rows).isEmpty()


def test_a_hot_key_is_reduced_before_the_shuffle(spark, tmp_path):
    """A third of all rows under one key reaches the exchange as one row per task."""
    n = 30_000
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    path = str(tmp_path / "requests")
    spark.range(0, n, 1, 4).select(
        F.lit("p").alias("pipeline_key"), hot.alias("release_version"), F.lit("r").alias("reason")
    ).write.parquet(path)
    requests = spark.read.parquet(path)
    asked = requests.select(F.col("release_version").alias("tag"))
    decided = refresh_decision(asked, requests)
    plan = decided._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_count") == 1
    assert "Window" not in plan and "CartesianProduct" not in plan
    assert decided.filter("tag = 'hot'").first()["n_requests"] == n // 3

    current = requests.select(F.lit("a").alias("attempt_id"), "pipeline_key", "release_version", F.lit("COMPLETED").alias("outcome"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        eligible = refresh_eligible(requests, current)
        plan = eligible._jdf.queryExecution().executedPlan().toString()
        # Both sides are made distinct on the join keys, so the join adds no exchange.
        assert plan.count("Exchange hashpartitioning") == 2
        assert plan.count("HashAggregate") == 4
        assert eligible.isEmpty()
    finally:
        spark.conf.set(threshold, before)
