"""Records that are taken away, and releases that start together."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.operators import (
    LEDGER_SCHEMA,
    NO_ENTRY,
    NO_RECORD,
    NOT_LINKED,
    NOT_THE_END,
    append_attempt,
    chain_breaks,
    chain_table,
    chained,
    ends,
    kept_heads,
    ledger_breaks,
    seal_ledger,
    with_integrity,
)
from millrace.plans import LedgerTampered, governed, governed_refresh
from millrace.sources import Taken, scan


@pytest.fixture
def ledger(database):
    return f"{database}.refresh_ledger"


def row(attempt, seq, pipeline="p", outcome="FAILED"):
    return (attempt, seq, pipeline, "1.0.1", "r", "t", None, None, None, outcome)


def sealed(spark, rows):
    return with_integrity(spark.createDataFrame(rows, LEDGER_SCHEMA))


def broken(*tables):
    return sorted((r.position or 0, r.problem) for r in chain_breaks(*tables).collect())


# --- the chain


ROWS = [row(f"a{n}", seq, f"p{n % 3}" if n % 5 else None) for n in range(12) for seq in (1, 2)]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("chain")
    record = sealed(spark, ROWS)
    record.write.parquet(f"{folder}/ledger")
    record = spark.read.parquet(f"{folder}/ledger")
    chained(record).write.parquet(f"{folder}/chain")
    chain = spark.read.parquet(f"{folder}/chain")
    ends(chain).write.parquet(f"{folder}/heads")
    return record, chain, spark.read.parquet(f"{folder}/heads")


def test_an_untouched_ledger_has_no_breaks(spark, whole):
    record, chain, heads = whole
    assert broken(*whole) == [] and heads.count() == 4 and chain.count() == len(ROWS)
    for empty in ([], ):
        none = sealed(spark, ROWS).where("false")
        assert broken(none, chained(none), ends(chained(none))) == []


@pytest.mark.parametrize("attempt", ["a1", "a4", "a7", "a11"])
@pytest.mark.parametrize("seq", [1, 2])
def test_any_record_taken_away_is_noticed(whole, attempt, seq):
    record, chain, heads = whole
    gone = f"NOT (attempt_id = '{attempt}' AND seq = {seq})"
    place = chain.where(f"NOT ({gone})").first().position
    length = {r.chain: r.position for r in heads.collect()}[chain.where(f"NOT ({gone})").first().chain]
    assert broken(record.where(gone), chain, heads) == [(place, NO_RECORD)]
    assert broken(record, chain.where(gone), heads) == sorted([(0, NO_ENTRY), (place + 1, NOT_LINKED) if place < length else (length, NOT_THE_END)])
    assert broken(record.where(gone), chain.where(gone), heads) == [(place + 1, NOT_LINKED) if place < length else (length, NOT_THE_END)]


def test_swapped_repeated_added_and_relinked_records_are_noticed(spark, whole):
    record, chain, heads = whole
    one = chain.where("attempt_id = 'a1'").orderBy("position").collect()
    first, second = one[0].position, one[1].position
    place = F.when(F.col("attempt_id") == "a1", F.lit(first + second) - F.col("position")).otherwise(F.col("position"))
    swapped = chain.withColumn("position", place)
    assert (first, NOT_LINKED) in broken(record, swapped, heads) and (second, NOT_LINKED) in broken(record, swapped, heads)
    assert broken(record.union(record.where("attempt_id = 'a1' AND seq = 1")), chain, heads) == [(0, NO_ENTRY)]
    assert broken(record.union(sealed(spark, [row("new", 1, "p9")])), chain, heads) == [(0, NO_ENTRY)]
    # Somebody who takes a record away and makes a whole new chain still does not have the head.
    shorter = record.where("attempt_id <> 'a4'")
    found = broken(shorter, chained(shorter), heads)
    assert [problem for _, problem in found] == [NOT_THE_END]
    assert broken(record, chain, heads.where("false")) == [(r.position, NOT_THE_END) for r in sorted(heads.collect(), key=lambda r: r.position)]
    doubled = chain.union(chain.where("attempt_id = 'a1' AND seq = 1"))
    assert (first, NO_RECORD) in broken(record, doubled, heads)


def test_a_chain_of_thousands_is_not_one_task(spark):
    n = 3000
    chain = spark.range(n).selectExpr("'c' AS chain", "id + 1 AS position", "string(id) AS attempt_id", "1 AS seq", "'i' AS integrity", "'l' AS link")
    found = chain_breaks(sealed(spark, ROWS).where("false"), chain, chain.where("false").select("chain", "position", "link"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where(F.col("problem") == NOT_LINKED).count() == n


@pytest.mark.parametrize("integrity", ["", "AB", "ab", "abc", "xy", "\u00e9", None])
def test_hashes_are_compared_as_bytes_and_odd_ones_are_told_apart(spark, integrity):
    record = sealed(spark, ROWS[:2]).withColumn("integrity", F.lit("ab"))
    chain = chained(record)
    other = record.withColumn("integrity", F.lit(integrity).cast("string"))
    found = chain_breaks(other, chain, ends(chain))
    assert "unhex" in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.chain, r.attempt_id, r.seq, r.problem) for r in found.collect())
    names = [(r.chain, r.attempt_id, r.seq) for r in chain.collect()]
    assert rows == ([] if integrity == "ab" else sorted((*n, p) for n in names for p in (NO_RECORD, NO_ENTRY)))


# --- the ledger table


def test_appended_attempts_are_chained_in_order(spark, ledger):
    for n in range(3):
        append_attempt(spark.createDataFrame([row(f"a{n}", 2), row(f"a{n}", 1), row("other", n, None)], LEDGER_SCHEMA), ledger)
    assert ledger_breaks(spark, ledger).isEmpty()
    places = scan(spark, chain_table(ledger), fresh=True).orderBy("position").collect()
    assert [(r.attempt_id, r.seq) for r in places if r.attempt_id != "other"] == [(f"a{n}", s) for n in range(3) for s in (1, 2)]
    assert sorted(r.position for r in kept_heads(spark, ledger).collect()) == [3, 6]


def test_a_ledger_without_a_chain_is_sealed_when_asked_for(spark, ledger):
    sealed(spark, ROWS).write.format("parquet").saveAsTable(ledger)
    assert ledger_breaks(spark, ledger).count() == len(ROWS)
    seal_ledger(spark, ledger)
    assert ledger_breaks(spark, ledger).isEmpty()
    append_attempt(spark.createDataFrame([row("next", 1, "p1")], LEDGER_SCHEMA), ledger)
    assert ledger_breaks(spark, ledger).isEmpty()
    with pytest.raises(ValueError, match="already"):
        seal_ledger(spark, ledger)


# --- releases


@pytest.fixture
def requests(spark):
    rows = [("orders_pipeline", "1.0.1", "r"), ("orders_pipeline", "1.0.2", "r"), ("orders_pipeline", "1.0.3", "r")]
    return spark.createDataFrame(rows, "pipeline_key STRING, release_version STRING, reason STRING")


def run(spark, tag, requests, ledger, refresher=lambda: "u"):
    return governed_refresh(spark, tag, requests, ledger, {"orders_pipeline": refresher}, tagger="tess")


@pytest.mark.parametrize("gone", [("1.0.1", "TRIGGERING"), ("1.0.1", "COMPLETED"), ("1.0.2", "TRIGGERING"), ("1.0.2", "COMPLETED")])
@pytest.mark.parametrize("of_chain_too", [False, True])
def test_taking_any_record_away_stops_the_next_run(spark, requests, ledger, gone, of_chain_too):
    assert [run(spark, tag, requests, ledger) for tag in ("1.0.1", "1.0.2")] == ["COMPLETED"] * 2
    record, chain = (scan(spark, t, fresh=True) for t in (ledger, chain_table(ledger)))
    victim = record.where((F.col("release_version") == gone[0]) & (F.col("outcome") == gone[1])).first()
    keep = ~((F.col("attempt_id") == victim.attempt_id) & (F.col("seq") == victim.seq))
    kept = [r.collect() for r in (record.where(keep), chain.where(keep) if of_chain_too else chain)]
    for table, rows, schema in zip((ledger, chain_table(ledger)), kept, (record.schema, chain.schema)):
        spark.sql(f"DROP TABLE {table}")
        spark.createDataFrame(rows, schema).write.format("parquet").saveAsTable(table)
    ran = []
    with pytest.raises(LedgerTampered):
        run(spark, "1.0.3", requests, ledger, lambda: ran.append(1) or "u")
    assert ran == []


def test_a_claim_without_a_record_blocks(spark, requests, ledger, monkeypatch):
    def cut_off(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(governed, "append_attempt", cut_off)
    with pytest.raises(KeyboardInterrupt):
        run(spark, "1.0.1", requests, ledger)
    monkeypatch.undo()
    assert run(spark, "1.0.1", requests, ledger) == "BLOCKED"
    assert run(spark, "1.0.2", requests, ledger) == "COMPLETED"


def test_of_two_releases_started_together_exactly_one_runs(spark, requests, ledger, monkeypatch):
    def failing():
        raise RuntimeError("cluster gone")

    # A failed attempt comes first, so that the ones together are the second of the release.
    with pytest.raises(RuntimeError):
        run(spark, "1.0.1", requests, ledger, failing)
    together, claim, ran = threading.Barrier(4, timeout=120), governed.take_claim, []

    def wait_then_claim(*args):
        together.wait()  # all have read the ledger by now, and none has written to it
        return claim(*args)

    monkeypatch.setattr(governed, "take_claim", wait_then_claim)
    with ThreadPoolExecutor(4) as pool:
        outcomes = list(pool.map(lambda n: run(spark, "1.0.1", requests, ledger, lambda: ran.append(n) or "u"), range(4)))
    assert sorted(outcomes) == ["BLOCKED"] * 3 + ["COMPLETED"] and len(ran) == 1
    assert ledger_breaks(spark, ledger).isEmpty()
    assert scan(spark, ledger, fresh=True).count() == 4
    monkeypatch.undo()
    assert run(spark, "1.0.1", requests, ledger) == "BLOCKED"


def test_a_name_is_taken_once(spark, tmp_path):
    files = Taken(spark, f"file:{tmp_path}/names with space")
    assert files.names() == [] and files.names("x") == []
    start = threading.Barrier(16, timeout=60)

    def attempt(n):
        start.wait()
        return [n for k in range(20) if files.take(f"x/{k:02d}", str(n))]

    with ThreadPoolExecutor(16) as pool:
        taken = list(pool.map(attempt, range(16)))
    assert sum(map(len, taken)) == 20
    assert files.names("x") == [f"{k:02d}" for k in range(20)]
    assert all(files.text(f"x/{k:02d}") in map(str, range(16)) for k in range(20))
