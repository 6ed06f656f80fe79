import json

import pytest

from millrace.operators import LEDGER_FIELDS, LEDGER_SCHEMA, NO_APPROVER, append_attempt, blocked_keys, current_outcomes, tampered
from millrace.plans import (
    AmbiguousRequest,
    LedgerTampered,
    full_refresh,
    governed_refresh,
    orders_pipeline,
    update,
)
from millrace.sources import landing_stream, scan


@pytest.fixture
def ledger(database):
    return f"{database}.refresh_ledger"


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(
        [
            ("orders_pipeline", "1.0.1", "landing files were corrected"),
            ("orders_pipeline", "1.0.2", "one"),
            ("other_pipeline", "1.0.2", "two"),
            ("absent_pipeline", "1.0.3", "nobody knows it"),
            (None, "1.0.4", "no pipeline"),
        ],
        "pipeline_key STRING, release_version STRING, reason STRING",
    )


class Refresher:
    def __init__(self, *results):
        self.results = list(results)
        self.calls = 0

    def __call__(self):
        self.calls += 1
        result = self.results.pop(0)
        if isinstance(result, BaseException):
            raise result
        return result


def run(spark, tag, requests, ledger, refresher, **kwargs):
    return governed_refresh(
        spark, tag, requests, ledger, {"orders_pipeline": refresher}, tagger="tess", **kwargs
    )


def outcomes(spark, ledger):
    return sorted((r["outcome"] for r in current_outcomes(scan(spark, ledger, fresh=True)).collect()), key=str)


def test_no_request_means_nothing_happens(spark, requests, ledger):
    refresher = Refresher("u1")
    for tag in ("1.0.0", "v1.0.1", "1.0"):
        assert run(spark, tag, requests, ledger, refresher) == "SKIP"
    assert refresher.calls == 0
    assert not spark.catalog.tableExists(ledger)


def test_several_requests_are_an_error(spark, requests, ledger):
    refresher = Refresher("u1")
    with pytest.raises(AmbiguousRequest, match="2 refresh requests"):
        run(spark, "1.0.2", requests, ledger, refresher)
    with pytest.raises(ValueError, match="names no pipeline"):
        run(spark, "1.0.4", requests, ledger, refresher)
    assert refresher.calls == 0
    assert not spark.catalog.tableExists(ledger)


def test_a_completed_refresh_is_recorded_and_runs_once(spark, requests, ledger):
    refresher = Refresher("u1")
    assert run(spark, "1.0.1", requests, ledger, refresher, run_link="http://run/1") == "COMPLETED"
    assert run(spark, "1.0.1", requests, ledger, refresher) == "BLOCKED"
    assert refresher.calls == 1
    rows = scan(spark, ledger, fresh=True).orderBy("seq").drop("attempt_id", "integrity").collect()
    common = ("orders_pipeline", "1.0.1", "landing files were corrected", "tess", NO_APPROVER)
    assert [tuple(r) for r in rows] == [
        (1, *common, None, "http://run/1", "TRIGGERING"),
        (2, *common, "u1", "http://run/1", "COMPLETED"),
    ]
    assert tampered(scan(spark, ledger)).isEmpty()


def test_the_claim_is_on_record_before_the_refresh_starts(spark, requests, ledger):
    seen = []
    assert run(spark, "1.0.1", requests, ledger, lambda: seen.append(outcomes(spark, ledger)) or "u") == "COMPLETED"
    assert seen == [["TRIGGERING"]]


def test_a_failed_refresh_may_be_tried_again_and_both_stay_on_record(spark, requests, ledger):
    refresher = Refresher(RuntimeError("cluster gone"), KeyboardInterrupt(), "u3")
    with pytest.raises(RuntimeError, match="cluster gone"):
        run(spark, "1.0.1", requests, ledger, refresher, approver="ann")
    assert outcomes(spark, ledger) == ["FAILED"]
    with pytest.raises(KeyboardInterrupt):
        run(spark, "1.0.1", requests, ledger, refresher, approver="ann")
    assert outcomes(spark, ledger) == ["FAILED", "OUTCOME UNKNOWN"]
    assert run(spark, "1.0.1", requests, ledger, refresher, approver="ann") == "COMPLETED"
    assert outcomes(spark, ledger) == ["COMPLETED", "FAILED", "OUTCOME UNKNOWN"]
    assert scan(spark, ledger).filter("approver = 'ann'").count() == 6


def test_a_refresh_that_cannot_start_is_recorded_as_failed(spark, requests, ledger):
    with pytest.raises(KeyError):
        run(spark, "1.0.3", requests, ledger, Refresher())
    assert outcomes(spark, ledger) == ["FAILED"]


def test_an_abandoned_claim_blocks(spark, requests, ledger):
    claim = ("a", 1, "orders_pipeline", "1.0.1", "r", "tess", None, None, None, "TRIGGERING")
    append_attempt(spark.createDataFrame([claim], LEDGER_SCHEMA), ledger)
    refresher = Refresher("u1")
    assert run(spark, "1.0.1", requests, ledger, refresher) == "BLOCKED"
    assert refresher.calls == 0


def test_altered_records_stop_the_run(spark, requests, ledger):
    refresher = Refresher("u1", "u2")
    assert run(spark, "1.0.1", requests, ledger, refresher) == "COMPLETED"
    rows = scan(spark, ledger, fresh=True).selectExpr(
        "*", "replace(outcome, 'COMPLETED', 'FAILED') AS edited"
    )
    rows.withColumn("outcome", rows["edited"]).drop("edited").write.saveAsTable(f"{ledger}_edited")
    with pytest.raises(LedgerTampered):
        run(spark, "1.0.1", requests, f"{ledger}_edited", refresher)
    assert refresher.calls == 1


@pytest.mark.parametrize("field", LEDGER_FIELDS)
def test_altering_any_field_of_both_rows_stops_the_run(spark, requests, ledger, field):
    refresher = Refresher("u1", "u2")
    assert run(spark, "1.0.1", requests, ledger, refresher) == "COMPLETED"
    other = "CAST(coalesce(seq, 0) + 5 AS INT)" if field == "seq" else f"concat(coalesce({field}, ''), '9')"
    scan(spark, ledger, fresh=True).selectExpr(f"* EXCEPT ({field})", f"{other} AS {field}").write.saveAsTable(f"{ledger}_edited")
    with pytest.raises(LedgerTampered):
        run(spark, "1.0.1", requests, f"{ledger}_edited", refresher)
    assert refresher.calls == 1


def test_a_row_without_a_position_blocks(spark, requests, ledger):
    common = ("orders_pipeline", "1.0.1", "r", "tess", None, None, None)
    rows = [("a", None, *common, "COMPLETED"), ("a", 1, *common, "FAILED")]
    append_attempt(spark.createDataFrame(rows, LEDGER_SCHEMA), ledger)
    assert outcomes(spark, ledger) == [None]
    assert blocked_keys(scan(spark, ledger)).count() == 1
    assert run(spark, "1.0.1", requests, ledger, Refresher("u1")) == "BLOCKED"


def test_blocked_keys_agree_with_current_outcomes(spark):
    rows = [
        (f"a{n}", seq, f"p{n % 40}", "1.0.0", None, None, None, None, None, ["FAILED", "COMPLETED", None, "OUTCOME UNKNOWN", "?"][(n * 7 + seq) % 5])
        for n in range(200) for seq in range(1 + n % 3)
    ]
    ledger = spark.createDataFrame(rows, LEDGER_SCHEMA)
    current = current_outcomes(ledger)
    expected = current.filter("NOT coalesce(outcome IN ('FAILED', 'OUTCOME UNKNOWN'), false)").select("pipeline_key").distinct()
    assert sorted(r[0] for r in blocked_keys(ledger).select("pipeline_key").collect()) == sorted(r[0] for r in expected.collect())
    plan = blocked_keys(ledger)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHash" not in plan


def test_release_of_the_orders_pipeline(spark, requests, ledger, database, tmp_path):
    landing = tmp_path / "orders"
    landing.mkdir()
    line = {"customer_id": "c", "amount": "1", "order_ts": "2026-01-01"}
    (landing / "a.json").write_text("".join(json.dumps({"order_id": n, **line}) + "\n" for n in (1, 2, None)))
    steps = orders_pipeline(
        lambda: landing_stream(spark, str(landing)), f"{database}.orders_raw", f"{database}.orders_bronze"
    )
    update(spark, steps)
    (landing / "a.json").write_text(json.dumps({"order_id": 3, **line}) + "\n")

    def refresh():
        return full_refresh(spark, steps).generation

    assert run(spark, "1.0.1", requests, ledger, refresh) == "COMPLETED"
    assert [r["order_id"] for r in spark.table(f"{database}.orders_bronze").collect()] == ["3"]
    ids = {r["update_id"] for r in scan(spark, ledger, fresh=True).collect()} - {None}
    described = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {database}.orders_bronze AS JSON").first()[0])
    assert f"gen={ids.pop()}/" in described["location"]
