"""Rows that break an expectation, kept in a table of their own."""

import pytest

from millrace.operators import Expectation, broken_rows
from millrace.plans import Step, current_generation, full_refresh, recompute, update
from millrace.sources import landing_stream
from millrace.streaming import updates

SCHEMA = "order_id STRING, amount STRING"
VALID, PAID = Expectation("has id", "order_id IS NOT NULL"), Expectation("paid", "CAST(amount AS INT) > 0")


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder


def land(folder, name, *rows):
    lines = ('{"order_id": %s, "amount": %s}\n' % tuple("null" if v is None else f'"{v}"' for v in r) for r in rows)
    (folder / name).write_text("".join(lines))


@pytest.fixture
def steps(spark, landing, database):
    raw, clean, broken = (f"{database}.{n}" for n in ("raw", "clean", "clean_broken"))
    return [
        Step(raw, lambda read: landing_stream(spark, str(landing), SCHEMA)),
        Step(clean, lambda read: read(raw), (VALID, PAID), broken=broken),
    ]


def contents(spark, step):
    kept = sorted(tuple(r) for r in spark.table(step.table).collect())
    return kept, sorted((r.order_id or "", r.amount or "", tuple(r._failed)) for r in spark.table(step.broken).collect())


A = [("1", "5"), (None, "2"), ("3", None), (None, "0")]
BROKEN_A = [("", "0", ("has id", "paid")), ("", "2", ("has id",)), ("3", "", ("paid",))]


def test_every_row_is_kept_or_broken(spark, landing, steps):
    land(landing, "a.json", *A)
    counts = update(spark, steps).counts[steps[1].table]
    assert contents(spark, steps[1]) == ([("1", "5")], BROKEN_A)
    assert (counts.seen, counts.dropped) == (4, 3)
    land(landing, "b.json", ("7", "7"), ("8", "-1"))
    update(spark, steps)
    assert contents(spark, steps[1]) == ([("1", "5"), ("7", "7")], sorted([*BROKEN_A, ("8", "-1", ("paid",))]))
    update(spark, steps)
    full_refresh(spark, steps)
    assert contents(spark, steps[1]) == ([("1", "5"), ("7", "7")], sorted([*BROKEN_A, ("8", "-1", ("paid",))]))
    assert current_generation(spark, steps[1].broken) == current_generation(spark, steps[1].table)


@pytest.mark.parametrize("where", ["kept rows", "broken rows", "counting"])
def test_a_cut_off_run_loses_and_repeats_nothing(spark, landing, steps, monkeypatch, where):
    land(landing, "a.json", *A)
    update(spark, steps)
    land(landing, "b.json", ("7", "7"), ("8", "-1"))
    appends = []

    def cut(*args, real=updates.append):
        appends.append(args[1])
        if len(appends) == {"kept rows": 2, "broken rows": 3}.get(where):
            raise KeyboardInterrupt
        return real(*args)

    def cut_counting(*args):
        if where == "counting":
            raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr("millrace.plans.pipelines.append", cut)
        if where == "counting":
            patch.setattr("millrace.plans.pipelines.start_counting", cut_counting)
        with pytest.raises(KeyboardInterrupt):
            update(spark, steps)
    land(landing, "c.json", ("9", None))
    counts = update(spark, steps).counts[steps[1].table]
    kept, broken = contents(spark, steps[1])
    assert (kept, broken) == ([("1", "5"), ("7", "7")], sorted([*BROKEN_A, ("8", "-1", ("paid",)), ("9", "", ("paid",))]))
    assert counts.seen == 3 and 4 + counts.seen == len(kept) + len(broken)


def test_batches_keep_broken_rows_too(spark, database):
    rows = spark.createDataFrame(A, SCHEMA)
    step = Step(f"{database}.clean", lambda read: rows, (VALID, PAID), broken=f"{database}.rest")
    assert recompute(spark, [step]).counts[step.table].dropped == 3
    assert contents(spark, step) == ([("1", "5")], BROKEN_A)
    with pytest.raises(ValueError, match="two steps"):
        recompute(spark, [step, Step(f"{database}.rest", lambda read: rows)])
    with pytest.raises(ValueError, match="_failed"):
        broken_rows(rows.withColumn("_failed", rows.order_id), (VALID,))
