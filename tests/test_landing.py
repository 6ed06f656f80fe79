import os

import pytest

from millrace.plans import full_refresh, orders_pipeline, update
from millrace.sources import landing_path, landing_stream, read_landing, source_path
from millrace.streaming import Counts, append_available


def land(folder, name, *lines, age_days=0):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))
    if age_days:
        then = path.stat().st_mtime - age_days * 86400
        os.utime(path, (then, then))


def order(n, amount="1.00", ts="2026-01-01 00:00:00"):
    return f'{{"order_id": "{n}", "customer_id": "c", "amount": "{amount}", "order_ts": "{ts}"}}'


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing" / "orders"
    folder.mkdir(parents=True)
    return folder


@pytest.fixture
def steps(spark, landing, database):
    return orders_pipeline(
        lambda: landing_stream(spark, str(landing)),
        f"{database}.orders_raw",
        f"{database}.orders_bronze",
    )


def ids(spark, steps):
    return sorted(r["order_id"] for r in spark.table(steps[1].table).collect())


def test_source_path_must_be_configured(spark):
    with pytest.raises(Exception, match="SQL_CONF_NOT_FOUND"):
        source_path(spark)
    spark.conf.set("source_path", " ")
    try:
        with pytest.raises(ValueError, match="empty"):
            source_path(spark)
        spark.conf.set("source_path", "/landing/orders")
        assert source_path(spark) == "/landing/orders"
    finally:
        spark.conf.unset("source_path")


def test_each_source_has_its_directory(spark, tmp_path):
    assert landing_path("/landing/", "orders") == "/landing/orders"
    for name in ("", "a/b", "..", "_hidden"):
        with pytest.raises(ValueError):
            landing_path("/landing", name)
    land(tmp_path / "landing" / "returns", "a.json", '{"return_id": 5}')
    land(tmp_path / "landing" / "orders", "a.json", order(1))
    returns = read_landing(spark, str(tmp_path / "landing"), "returns", "return_id STRING")
    append_available(returns, str(tmp_path / "data"), str(tmp_path / "ckpt"))
    rows = spark.read.parquet(str(tmp_path / "data")).collect()
    assert [r.asDict() for r in rows] == [{"return_id": "5"}]


def test_a_missing_landing_directory_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landing_stream(spark, str(tmp_path / "nowhere"))


def test_forms_of_landed_lines(spark, landing, steps):
    land(
        landing,
        "a.json",
        '{"order_id": 1, "customer_id": 7, "amount": 10.5, "order_ts": "2026-01-01 00:00:00"}',
        '{"order_id": "2", "amount": "3", "channel": "web"}',
        '{"order_id": "3", "amount": {"value": 3}}',
        '{"order_id": "4", "amount": 1234567890123456.78}',
        '{"order_id": "5", "amount": 12345678.9}',
        '{"order_id": ""}',
        '{"order_id": null, "customer_id": "9"}',
        '{"customer_id": "9"}',
        '{"order_id": "8", "amount": ',
        "",
        "[]",
    )
    counts = update(spark, steps).counts
    raw = {r["order_id"]: r for r in spark.table(steps[0].table).collect() if r["order_id"]}
    assert (raw["1"]["customer_id"], raw["1"]["amount"]) == ("7", "10.5")
    assert raw["3"]["amount"] == '{"value": 3}' or raw["3"]["amount"] == '{"value":3}'
    bronze = {r["order_id"]: r["amount"] for r in spark.table(steps[1].table).collect()}
    shown = {k: None if v is None else str(v) for k, v in bronze.items()}
    assert shown == {
        "1": "10.50",
        "2": "3.00",
        "3": None,
        "4": "1234567890123456.78",
        "5": "12345678.90",
        "": None,
    }
    seen = counts[steps[1].table].seen
    assert counts[steps[1].table] == Counts(seen, seen - 6, {"valid_order_id": seen - 6})
    assert spark.table(steps[0].table).count() == seen


def test_files_are_ingested_once_wherever_and_whenever_they_arrive(spark, landing, steps):
    land(landing, "a.json", order(1), order(2))
    land(landing, "2026/01/b.json", order(3))
    land(landing, "day=5/c.json", order(4))
    land(landing, "_tmp.json", order(99))
    assert update(spark, steps).counts[steps[1].table].seen == 4
    assert ids(spark, steps) == ["1", "2", "3", "4"]
    assert spark.table(steps[0].table).columns == ["order_id", "customer_id", "amount", "order_ts"]

    nothing = update(spark, steps).counts
    assert nothing[steps[0].table] == nothing[steps[1].table] == Counts()
    assert ids(spark, steps) == ["1", "2", "3", "4"]

    land(landing, "late.json", order(5), age_days=400)
    land(landing, "late-too.json", '{"customer_id": "nobody"}')
    assert update(spark, steps).counts[steps[1].table] == Counts(2, 1, {"valid_order_id": 1})
    assert ids(spark, steps) == ["1", "2", "3", "4", "5"]


def test_every_batch_is_counted_however_many_there_are(spark, landing, database):
    for n in range(12):
        land(landing, f"{n}.json", order(n), '{"customer_id": "nobody"}')
    retained = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(retained)
    spark.conf.set(retained, "2")
    try:
        steps = orders_pipeline(
            lambda: landing_stream(spark, str(landing), batch_bytes=1),
            f"{database}.orders_raw",
            f"{database}.orders_bronze",
        )
        counts = update(spark, steps).counts
        assert spark.conf.get(retained) == "2"
    finally:
        spark.conf.set(retained, before)
    assert counts[steps[0].table].seen == 24
    assert counts[steps[1].table] == Counts(24, 12, {"valid_order_id": 12})
    log = spark.read.text(str(landing.parent.parent / "db" / "generations" / "*" / "*" / "orders_raw" / "ckpt" / "commits"))
    assert log.select("_metadata.file_path").distinct().count() == 12


def test_an_empty_landing_directory_gives_empty_tables(spark, landing, steps):
    assert update(spark, steps).counts[steps[1].table] == Counts()
    assert spark.table(steps[1].table).count() == 0
    land(landing, "a.json", order(1))
    update(spark, steps)
    assert ids(spark, steps) == ["1"]


def test_an_unreadable_timestamp_fails_the_update_even_on_a_dropped_row(spark, landing, steps):
    land(landing, "a.json", order(1))
    update(spark, steps)
    land(landing, "b.json", order(2), '{"customer_id": "nobody", "order_ts": "soon"}')
    for _ in range(2):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            update(spark, steps)
        assert ids(spark, steps) == ["1"]
    # The raw table took the file in; once it is put right, a refresh reads it again.
    assert spark.table(steps[0].table).count() == 3
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        full_refresh(spark, steps)
    assert ids(spark, steps) == ["1"]
    land(landing, "b.json", order(2), order(3))
    full_refresh(spark, steps)
    assert ids(spark, steps) == ["1", "2", "3"]
    assert spark.table(steps[0].table).count() == 3


def test_rows_of_an_uncommitted_batch_stay_invisible(spark, landing, steps):
    land(landing, "a.json", order(1))
    generation = update(spark, steps).generation
    data = landing.parent.parent / "db" / "generations" / "orders_bronze" / f"gen={generation}" / "orders_bronze" / "data"
    written = next(data.glob("part-*.parquet"))
    (data / "part-leftover.parquet").write_bytes(written.read_bytes())
    spark.catalog.refreshTable(steps[1].table)
    assert ids(spark, steps) == ["1"]


def test_a_file_dated_far_in_the_future_hides_no_later_one(spark, landing, steps):
    land(landing, "future.json", order(1), age_days=-84_000)
    update(spark, steps)
    land(landing, "normal.json", order(2))
    assert update(spark, steps).counts[steps[1].table].seen == 1
    assert ids(spark, steps) == ["1", "2"]
