"""Queries over the given tables, one or more per operator, with SQL for the same results.

The given ``orders`` are typed already, so most queries first turn them back
into raw text rows: some ids are missing and some amounts cannot be read.
Requests, tags and attempts are derived from customers, nations and events.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The package lies beside this file, which may be loaded from anywhere.
sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.functions import Field
from millrace.operators import (
    LEDGER_FIELDS,
    PROCESSED_AT,
    VALID_ORDER_ID,
    Expectation,
    blocked_keys,
    chain_breaks,
    chain_of,
    chained,
    column_report,
    conform,
    contract,
    current_outcomes,
    differing_rows,
    ends,
    expect_or_drop,
    expectation_counts,
    refresh_decision,
    null_count,
    refresh_eligible,
    refresh_unblocked,
    release_tags,
    requested_refreshes,
    table_difference,
    tampered,
    transform_orders,
    with_approver_default,
    with_integrity,
)
from millrace.plans import (
    Shown,
    Step,
    Update,
    begin,
    create_layers,
    current_generation,
    full_refresh as refresh_all,
    governed_refresh as release,
    new_generation,
    orders_pipeline,
    reading,
    recompute,
    retire_generations,
    settle,
    show,
    target,
    update,
)
from millrace.session import pin, shared_folder
from millrace.streaming import append
from millrace.sources import landing_path, landing_stream, orders_raw, read_landing, scan, source_path

SMOKE_DIR = "/root/testdata/sf0.001"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> F.Column:
    return F.col(column).cast("string")


def _one_of(forms: list[F.Column], key: str) -> F.Column:
    """The form whose turn it is by the row's key. Only that one is computed."""
    turn = F.col(key) % len(forms)
    chosen = F.when(turn == 0, forms[0])
    for position, form in enumerate(forms[1:], start=1):
        chosen = chosen.when(turn == position, form)
    return chosen


# --- raw and cleaned orders -------------------------------------------------


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_raw(_table(spark, sf_dir, "orders"))


def _as_raw(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders.select(
        F.when(F.col("o_orderkey") % 97 != 0, _text("o_orderkey")).alias("order_id"),
        _text("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderkey") % 53 == 0, "not-a-number").otherwise(price).alias("amount"),
        _text("o_orderdate").alias("order_ts"),
    )


def _comparable(cleaned: DataFrame) -> DataFrame:
    """Without the processing time, and with the zone-less timestamp other engines give."""
    return cleaned.drop(PROCESSED_AT).withColumn("order_ts", F.col("order_ts").cast("timestamp_ntz"))


def orders_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(expect_or_drop(transform_orders(raw_orders(spark, sf_dir)), VALID_ORDER_ID))


def inline_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows, whose ids are integers, together with the table's text rows."""
    cleaned = transform_orders(orders_raw(spark)).unionByName(transform_orders(raw_orders(spark, sf_dir)))
    return _comparable(expect_or_drop(cleaned, VALID_ORDER_ID))


def tolerant_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, buyer = F.col("price"), F.col("buyer")
    forms = [
        price,
        F.concat(F.lit("  "), price, F.lit(" ")),
        F.concat(F.lit("+"), price),
        F.concat(F.lit("-"), price, F.lit("5")),
        F.concat(price, F.lit("49")),
        F.concat(buyer, F.lit(".")),
        F.concat(F.lit("."), buyer),
        F.concat(buyer, F.lit("e3")),
        F.concat(F.lit("$"), price),
        F.lit(""),
        F.concat(F.lit("9999999999999999"), price),
        F.lit("NaN"),
    ]
    parts = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        _text("o_custkey").alias("buyer"),
    )
    written = parts.select("o_orderkey", _one_of(forms, "o_orderkey").alias("amount"))
    fields = [Field("o_orderkey", "string"), Field("amount", "decimal(18,2)", tolerant=True)]
    return conform(written, fields)


def strict_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate")
    forms = [
        when.cast("string"),
        F.date_format(when, "yyyy-MM-dd"),
        F.date_format(when, "yyyy-M-d '9:15'"),
        F.date_format(when, "yyyy-MM-dd'T09:15:00Z'"),
    ]
    written = _table(spark, sf_dir, "orders").select(
        "o_orderkey", _one_of(forms, "o_orderkey").alias("order_ts")
    )
    read = conform(written, [Field("o_orderkey", "string"), Field("order_ts", "timestamp")])
    return read.withColumn("order_ts", F.col("order_ts").cast("timestamp_ntz"))


def processed_at_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = transform_orders(raw_orders(spark, sf_dir))
    return cleaned.select("order_id", F.col(PROCESSED_AT).isNotNull().alias("stamped"))


# --- checks -----------------------------------------------------------------


def expectation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectation_counts(transform_orders(raw_orders(spark, sf_dir)), VALID_ORDER_ID)


def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of cleaned orders, and of two columns that break it."""
    cleaned = transform_orders(raw_orders(spark, sf_dir)).withColumn("channel", F.lit(1))
    return column_report(cleaned, contract() | {"channel": "string", "region": "string"})


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = transform_orders(raw_orders(spark, sf_dir))
    row = (cleaned.count(), null_count(cleaned, "amount"), null_count(cleaned, PROCESSED_AT))
    return spark.createDataFrame([row], "n_rows LONG, null_amounts LONG, unstamped LONG")


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned orders against a copy with changed, missing and repeated rows."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.col("o_orderdate").alias("order_ts"),
    )
    key = F.col("order_id")
    copies = F.when(key % 1500 == 11, 0).when(key % 2000 == 13, 3).otherwise(1)
    copy = (
        orders.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
        .drop("copy")
        .withColumn("customer_id", F.when(key % 1000 == 7, -1).otherwise(F.col("customer_id")))
    )
    return table_difference(_comparable(transform_orders(orders)), _comparable(transform_orders(copy)))


def _changed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned orders, and a stored-like copy in which few rows differ."""
    cleaned = _comparable(transform_orders(raw_orders(spark, sf_dir)))
    key = F.col("order_id").cast("long")
    copies = F.when(key % 1500 == 11, 0).when(key % 2000 == 13, 3).otherwise(1)
    copy = cleaned.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("copy")
    changed = F.when(key % 1000 == 7, "-1").otherwise(F.col("customer_id"))
    return cleaned, copy.withColumn("customer_id", changed)


def changed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all rows, then only the rows of buckets that differ."""
    return differing_rows(*_changed_sides(spark, sf_dir))


def customers_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison in which few distinct rows repeat very often on both sides."""
    orders = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("o_orderstatus"), F.lit("5-LOW").alias("o_orderpriority")
    )
    return table_difference(orders, lines)


# --- tables -----------------------------------------------------------------


class _Workplace:
    """A database of one run's own, in the folder the executors share."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = pin(spark)
        self.folder = shared_folder(spark, purpose)
        self.user = f"run{uuid4().hex}"
        create_layers(spark, "dev", self.user, root=self.folder)
        self.raw, self.bronze, self.ledger = (
            target("dev", "bronze", name, self.user)
            for name in ("orders_raw", "orders_bronze", "refresh_ledger")
        )

    def land(self, rows: DataFrame, arrival: str) -> None:
        rows.write.json(f"{self.folder}/landing/orders/{arrival}")

    def streamed(self) -> tuple[Step, Step]:
        return orders_pipeline(
            lambda: read_landing(self.spark, f"{self.folder}/landing"), self.raw, self.bronze
        )

    def counts(self, runs: dict[str, Update]) -> DataFrame:
        rows = [
            (run, table.rpartition(".")[2], counts.seen, counts.dropped)
            for run, done in runs.items()
            for table, counts in done.counts.items()
        ]
        return self.spark.createDataFrame(
            rows, "run STRING, table_name STRING, seen LONG, dropped LONG"
        )


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _Workplace(spark, "table_roundtrip")
    recompute(spark, [Step(place.raw, lambda read: raw_orders(spark, sf_dir))])
    return scan(spark, place.raw)


def _recomputed(place: _Workplace, sf_dir: str) -> Update:
    steps = orders_pipeline(lambda: raw_orders(place.spark, sf_dir), place.raw, place.bronze)
    return recompute(place.spark, steps)


def raw_to_bronze_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _Workplace(spark, "raw_to_bronze_tables")
    _recomputed(place, sf_dir)
    return _comparable(scan(spark, place.bronze))


def recompute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _Workplace(spark, "recompute_counts")
    counts = place.counts({"recompute": _recomputed(place, sf_dir)})
    comments = [(t.rpartition(".")[2], spark.catalog.getTable(t).description) for t in (place.raw, place.bronze)]
    return counts.join(spark.createDataFrame(comments, "table_name STRING, comment STRING"), "table_name")


def _land_early_and_late(place: _Workplace, sf_dir: str) -> tuple[Callable, Callable]:
    orders = _table(place.spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return (
        lambda: place.land(_as_raw(orders.filter(early)), "early"),
        lambda: place.land(_as_raw(orders.filter(~early)), "late"),
    )


def landing_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _Workplace(spark, "landing_incremental")
    for arrive in _land_early_and_late(place, sf_dir):
        arrive()
        update(spark, place.streamed())
    return _comparable(scan(spark, place.bronze))


def update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _Workplace(spark, "update_counts")
    early, late = _land_early_and_late(place, sf_dir)
    early()
    first = update(spark, place.streamed())
    late()
    second = update(spark, place.streamed())
    idle = update(spark, place.streamed())
    return place.counts({"first": first, "second": second, "idle": idle})


def update_counts_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run ends after it wrote the raw rows and before it counted any; the next one counts them."""
    place = _Workplace(spark, "update_counts_cut_off")
    early, late = _land_early_and_late(place, sf_dir)
    early()
    first = update(spark, place.streamed())
    late()
    generation = current_generation(spark, place.bronze)
    landed = read_landing(spark, f"{place.folder}/landing")
    append(landed, generation.data(place.raw), generation.checkpoint(place.raw))
    second = update(spark, place.streamed())
    idle = update(spark, place.streamed())
    return place.counts({"first": first, "second": second, "idle": idle})


def kept_and_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates with two expectations; every row is in the table or, with what it fails, beside it."""
    place = _Workplace(spark, "kept_and_broken")
    rest = target("dev", "bronze", "orders_broken", place.user)
    priced = Expectation("priced", "amount IS NOT NULL")

    def steps() -> tuple[Step, Step]:
        raw, bronze = place.streamed()
        return raw, replace(bronze, expectations=(VALID_ORDER_ID, priced), broken=rest)

    for arrive in _land_early_and_late(place, sf_dir):
        arrive()
        update(spark, steps())
    kept = scan(spark, place.bronze).withColumn("failed", F.lit(""))
    broken = scan(spark, rest).withColumn("failed", F.array_join("_failed", ",")).drop("_failed")
    return _comparable(kept.unionByName(broken))


def steps_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables, written again from more rows with the steps the wrong way round."""
    place = _Workplace(spark, "steps_out_of_order")
    priced = target("dev", "bronze", "a_priced", place.user)

    def steps(rows: DataFrame) -> tuple[Step, ...]:
        known = Step(priced, lambda read: read(place.bronze).filter("amount IS NOT NULL"))
        return (*orders_pipeline(lambda: rows, place.raw, place.bronze), known)

    raw = raw_orders(spark, sf_dir)
    recompute(spark, steps(raw.filter("order_ts < '1996-01-01'")))
    recompute(spark, steps(raw)[::-1])
    return _comparable(scan(spark, priced))


def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _Workplace(spark, "full_refresh")
    early, late = _land_early_and_late(place, sf_dir)
    early()
    update(spark, place.streamed())
    late()
    refresh_all(spark, place.streamed())
    return _comparable(scan(spark, place.bronze))


def refresh_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that end after the first pointer and after the last one; what the tables show once that is settled."""
    place = _Workplace(spark, "refresh_cut_off")
    raw = raw_orders(spark, sf_dir)
    steps = lambda rows: orders_pipeline(lambda: rows, place.raw, place.bronze)
    recompute(spark, steps(raw.filter("order_ts < '1996-01-01'")))
    rows = {place.raw: raw, place.bronze: expect_or_drop(transform_orders(raw), VALID_ORDER_ID)}
    new = new_generation(spark, place.bronze, streamed=False)
    for table, content in rows.items():
        content.write.parquet(new.data(table))
    move = [Shown(table, content.schema, "") for table, content in rows.items()]
    found = []
    for pointers in (1, 2):
        begin(spark, move, new)
        for to in move[:pointers]:
            show(spark, to.table, new, to.schema, to.comment)
        outcome = settle(spark, place.bronze)
        found += [(pointers, outcome, t.rpartition(".")[2], scan(spark, t).count()) for t in rows]
    return spark.createDataFrame(found, "pointers INT, outcome STRING, table_name STRING, n_rows LONG")


def leased_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader of two tables while both are replaced and old files retired, and one after that."""
    place = _Workplace(spark, "leased_reading")
    raw = raw_orders(spark, sf_dir)
    steps = lambda rows: orders_pipeline(lambda: rows, place.raw, place.bronze)

    def seen(reader: str, frames: list[DataFrame]) -> list[tuple]:
        totals = F.count(F.lit(1)), F.count_distinct("customer_id"), F.max("order_ts").cast("string")
        return [(reader, name, *rows.agg(*totals).first()) for name, rows in zip(("raw", "bronze"), frames, strict=True)]

    recompute(spark, steps(raw.filter("order_ts < '1996-01-01'")))
    with reading(spark, place.raw, place.bronze) as frames:
        recompute(spark, steps(raw))
        retired = len(retire_generations(spark, place.bronze, keep=0))
        found = seen(f"before, {retired} retired", frames)
    retired = len(retire_generations(spark, place.bronze, keep=0))
    with reading(spark, place.raw, place.bronze) as frames:
        found += seen(f"after, {retired} retired", frames)
    return spark.createDataFrame(found, "reader STRING, table_name STRING, n_rows LONG, n_customers LONG, latest STRING")


def landing_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they may really arrive: bare numbers, nested, missing, unknown, cut off, blank."""
    orders = _table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    key, buyer, when = _text("o_orderkey"), _text("o_custkey"), _text("o_orderdate")
    lines = [
        F.format_string(
            '{"order_id":"%s","customer_id":"%s","amount":"%s","order_ts":"%s"}', key, buyer, price, when
        ),
        F.format_string('{"order_id":%s,"customer_id":%s,"amount":%s,"order_ts":"%s"}', key, buyer, price, when),
        F.format_string('{"order_id":"%s","channel":{"name":"web"},"amount":"%s"}', key, price),
        F.format_string('{"order_id":"%s","order_ts":"%s"}', key, when),
        F.format_string('{"order_id":"%s","customer_id":"%s","amount":{"value":%s}}', key, buyer, price),
        F.format_string('{"order_id":"%s","customer_id":"%s","amount', key, buyer),
        F.lit(""),
        F.format_string('{"order_id":null,"customer_id":"%s","amount":"%s"}', buyer, price),
    ]
    place = _Workplace(spark, "landing_forms")
    orders.select(_one_of(lines, "o_orderkey").alias("value")).write.text(
        f"{place.folder}/landing/orders/forms"
    )
    configured = spark.conf.get("source_path", None)
    spark.conf.set("source_path", landing_path(f"{place.folder}/landing", "orders"))
    try:
        update(spark, orders_pipeline(lambda: landing_stream(spark, source_path(spark)), place.raw, place.bronze))
    finally:
        spark.conf.unset("source_path") if configured is None else spark.conf.set("source_path", configured)
    return _comparable(scan(spark, place.bronze))


# --- refresh rules ----------------------------------------------------------


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    minor = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("minor")
    pairs = _table(spark, sf_dir, "nation").select("n_nationkey", minor)
    return pairs.select(F.concat_ws(".", "n_nationkey", "minor", F.lit("0")).alias("tag"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    release_version = F.concat_ws(".", "c_nationkey", F.col("c_custkey") % 40, F.lit("0"))
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), "c_custkey").alias("pipeline_key"),
        release_version.alias("release_version"),
        F.col("c_mktsegment").alias("reason"),
    )


def tags_of_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    version = F.concat_ws(".", key % 11, key % 29, key % 997)
    forms = [
        version,
        F.concat(F.lit("v"), version),
        F.concat(version, F.lit("-rc1")),
        F.concat(version, F.lit(".4")),
        F.concat_ws(".", key % 11, key % 29),
        F.concat(version, F.lit(" ")),
        F.concat(version, F.lit("\n")),
    ]
    tags = _table(spark, sf_dir, "orders").select(_one_of(forms, "o_orderkey").alias("tag"))
    return release_tags(tags)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_decision(_tags(spark, sf_dir), _requests(spark, sf_dir))


def _block_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tags as the customers are many: 25 for every block of 40 customers."""
    tag = F.concat_ws(".", F.col("c_custkey") % 25, F.expr("c_custkey div 40"), F.lit("0"))
    return _table(spark, sf_dir, "customer").select(tag.alias("tag"))


def _block_release() -> F.Column:
    return F.concat_ws(".", "c_nationkey", F.expr("c_custkey div 40"), F.lit("0")).alias("release_version")


def _block_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), "c_custkey").alias("pipeline_key"),
        _block_release(),
        F.col("c_mktsegment").alias("reason"),
    )


def decisions_many_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_decision(_block_tags(spark, sf_dir), _block_requests(spark, sf_dir))


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requested_refreshes(_block_tags(spark, sf_dir), _block_requests(spark, sf_dir))


def _event_key(shift: int) -> list[F.Column]:
    minor = (F.col("event_id") + shift) % 41
    return [
        F.concat(F.lit("p"), "user_id").alias("pipeline_key"),
        F.concat(F.lit("1."), minor, F.lit(".0")).alias("release_version"),
    ]


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    outcome = (
        F.when(F.col("event_type") == "error", "FAILED")
        .when(F.col("event_type") == "view", "OUTCOME UNKNOWN")
        .when(F.col("event_type") == "click", "TRIGGERING")
        .otherwise("COMPLETED")
    )
    current = events.select(_text("event_id").alias("attempt_id"), *_event_key(7), outcome.alias("outcome"))
    return refresh_eligible(events.select(*_event_key(0)), current)


def _ledger(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """A claim per event, then an outcome unless the event is a click; some outcomes are odd."""
    event = F.col("event_type")
    seqs = F.when(event == "click", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    ended = F.col("seq") == 2
    outcome = (
        F.when(~ended, "TRIGGERING")
        .when(event == "error", "FAILED")
        .when(event == "view", "OUTCOME UNKNOWN")
        .when(event == "purchase", "COMPLETED")
        .when(F.col("event_id") % 2 == 0, "cancelled?")
    )
    return (
        _table(spark, sf_dir, "events")
        .withColumn("seq", F.explode(seqs))
        .select(
            F.concat(F.lit("a"), "event_id").alias("attempt_id"),
            "seq",
            *_event_key(shift),
            F.col("props").alias("reason"),
            F.concat(F.lit("user"), F.col("user_id") % 7).alias("tagger"),
            F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("lead"), F.col("user_id") % 3)).alias("approver"),
            F.when(ended, F.concat(F.lit("u"), "event_id")).alias("update_id"),
            F.concat(F.lit("https://example.org/runs/"), "event_id").alias("run_link"),
            outcome.alias("outcome"),
        )
    )


def ledger_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some outcomes have lost their position, so their attempts block."""
    lost = (F.col("seq") == 2) & (F.substring("attempt_id", 2, 20).cast("long") % 60 == 0)
    return current_outcomes(_ledger(spark, sf_dir).withColumn("seq", F.when(~lost, F.col("seq"))))


def eligible_from_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _table(spark, sf_dir, "events").select(*_event_key(0))
    return refresh_unblocked(requests, blocked_keys(_ledger(spark, sf_dir, shift=7)))


def ledger_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_integrity(_ledger(spark, sf_dir)).select("attempt_id", "seq", "integrity")


def ledger_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = with_integrity(with_approver_default(_ledger(spark, sf_dir)))
    event_id = F.substring("attempt_id", 2, 20).cast("long")
    altered = sealed.withColumns(
        {
            "reason": F.when(event_id % 50 == 0, F.concat("reason", F.lit("!"))).otherwise(F.col("reason")),
            "approver": F.when(event_id % 70 == 3, "lead9").otherwise(F.col("approver")),
            "integrity": F.when(event_id % 90 != 4, F.col("integrity")),
        }
    )
    return tampered(altered).select("attempt_id", "seq")


def ledger_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records taken out of the ledger, out of the chain too, off its end, and entries that changed places."""
    folder = shared_folder(pin(spark), "ledger_breaks")
    with_integrity(with_approver_default(_ledger(spark, sf_dir))).write.parquet(f"{folder}/ledger")
    sealed = spark.read.parquet(f"{folder}/ledger")
    chained(sealed).write.parquet(f"{folder}/chain")
    chain = spark.read.parquet(f"{folder}/chain")
    ends(chain).write.parquet(f"{folder}/heads")
    heads = spark.read.parquet(f"{folder}/heads")
    event_id, seq = F.substring("attempt_id", 2, 20).cast("long"), F.col("seq")
    from_both = (event_id % 70 == 3) & (seq == 1)
    length = heads.select("chain", F.col("position").alias("length"))
    ended = chain.join(length, "chain").filter((F.col("position") == F.col("length")) & (event_id % 11 == 0))
    ended.select("attempt_id", "seq").write.parquet(f"{folder}/ended")
    ended = spark.read.parquet(f"{folder}/ended")
    both = F.count("*").over(Window.partitionBy("chain", "attempt_id")) == 2
    moved = F.when(both & (seq == 1), F.col("position") + 1).when(both & (seq == 2), F.col("position") - 1).otherwise(F.col("position"))

    def some(rows: DataFrame, which: F.Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All rows, some changed; only these are shuffled for it."""
        asked = F.coalesce(which, F.lit(False))
        return rows.filter(~asked).unionByName(change(rows.filter(asked)).select(rows.columns))

    def not_ended(rows: DataFrame) -> DataFrame:
        return some(rows, event_id % 11 == 0, lambda found: found.join(ended, ["attempt_id", "seq"], "left_anti"))

    ledger = not_ended(sealed.filter(~from_both & ~((event_id % 50 == 0) & (seq == 2))))
    left = some(chain, event_id % 90 == 4, lambda found: found.withColumn("position", moved))
    left = not_ended(left.filter(~from_both))
    key = sealed.select("pipeline_key").distinct().withColumn("chain", chain_of())
    breaks = chain_breaks(ledger, left, heads)
    return breaks.join(key, "chain").select("pipeline_key", "position", "attempt_id", "seq", "problem")


def approver_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_approver_default(_ledger(spark, sf_dir)).select(*LEDGER_FIELDS)


def releases_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tags, requests and attempts to the refreshes that may run, for all releases at once."""
    segment = F.col("c_mktsegment")
    seqs = (
        F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<int>"))
        .when(segment == "FURNITURE", F.array(F.lit(1)))
        .otherwise(F.array(F.lit(1), F.lit(2)))
    )
    outcome = (
        F.when(F.col("seq") == 1, "TRIGGERING")
        .when(segment == "BUILDING", "FAILED")
        .when(segment == "MACHINERY", "OUTCOME UNKNOWN")
        .otherwise("COMPLETED")
    )
    ledger = (
        _table(spark, sf_dir, "customer")
        .withColumn("seq", F.explode(seqs))
        .select(
            F.concat(F.lit("a"), "c_custkey").alias("attempt_id"),
            "seq",
            F.concat(F.lit("p"), "c_custkey").alias("pipeline_key"),
            _block_release(),
            outcome.alias("outcome"),
        )
    )
    tags = release_tags(_block_tags(spark, sf_dir))
    asked = requested_refreshes(tags, _block_requests(spark, sf_dir))
    return refresh_unblocked(asked, blocked_keys(ledger))


def governed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release carried out twice: the second run finds the first on record."""
    place = _Workplace(spark, "governed_refresh")
    early, late = _land_early_and_late(place, sf_dir)
    early()
    update(spark, place.streamed())
    late()
    ours = spark.createDataFrame(
        [("orders_pipeline", "100.0.1", "landing was put right")],
        "pipeline_key STRING, release_version STRING, reason STRING",
    )
    requests = _requests(spark, sf_dir).unionByName(ours)
    refreshers = {"orders_pipeline": lambda: refresh_all(spark, place.streamed()).generation}
    for _ in range(2):
        release(spark, "100.0.1", requests, place.ledger, refreshers, tagger="tess")
    rows = scan(spark, place.bronze).agg(F.count(F.lit(1)).alias("bronze_rows"))
    recorded = scan(spark, place.ledger, fresh=True).select(
        "seq", "pipeline_key", "release_version", "reason", "tagger", "approver", "outcome"
    )
    return recorded.withColumn("bronze_rows", rows.scalar())


# --- the driver's contract --------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    return orders_bronze(spark, SMOKE_DIR)


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators, where they can be imported."""
    found, sql = {}, {}
    try:
        from millrace.llm.queries import ORACLE_SQL, QUERIES

        found |= QUERIES
        sql |= ORACLE_SQL
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as missing:
        # Only the part itself may be absent; what it lacks in turn is an error.
        if missing.name not in ("millrace.llm", "millrace.llm.queries", "corpus_pipeline"):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return _own_sql() | _training_data()[1]


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "raw_orders": raw_orders,
        "orders_bronze": orders_bronze,
        "inline_orders": inline_orders,
        "tolerant_amount": tolerant_amount,
        "strict_timestamp": strict_timestamp,
        "processed_at_present": processed_at_present,
        "expectation_counts": expectation_count,
        "schema_contract": schema_contract,
        "null_count": null_counts,
        "table_difference": changed_rows,
        "table_difference_repeated_rows": customers_compared,
        "differing_rows": changed_buckets,
        "table_roundtrip": table_roundtrip,
        "raw_to_bronze_tables": raw_to_bronze_tables,
        "recompute_counts": recompute_counts,
        "landing_incremental": landing_incremental,
        "landing_forms": landing_forms,
        "update_counts": update_counts,
        "update_counts_cut_off": update_counts_cut_off,
        "steps_out_of_order": steps_out_of_order,
        "kept_and_broken": kept_and_broken,
        "full_refresh": full_refresh,
        "refresh_cut_off": refresh_cut_off,
        "leased_reading": leased_reading,
        "release_tags": tags_of_releases,
        "refresh_decision": decisions,
        "refresh_decision_many_tags": decisions_many_tags,
        "requested_refreshes": requested,
        "refresh_eligible": eligible,
        "ledger_current": ledger_current,
        "eligible_from_ledger": eligible_from_ledger,
        "ledger_integrity": ledger_integrity,
        "ledger_tampered": ledger_tampered,
        "ledger_breaks": ledger_breaks,
        "approver_default": approver_default,
        "releases_to_run": releases_to_run,
        "governed_refresh": governed_refresh,
    }


_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"

_RAW = f"""
raw AS (
  SELECT CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE WHEN o_orderkey % 53 = 0 THEN 'not-a-number' ELSE {_PRICE} END AS amount,
         CAST(o_orderdate AS VARCHAR) AS order_ts
  FROM orders
)"""

_CLEANED = f"""{_RAW},
cleaned AS (
  SELECT order_id, customer_id, TRY_CAST(amount AS DECIMAL(18,2)) AS amount,
         CAST(order_ts AS TIMESTAMP) AS order_ts
  FROM raw
)"""

_BRONZE = f"WITH {_CLEANED} SELECT * FROM cleaned WHERE order_id IS NOT NULL"

_TAGS = """
tags AS (
  SELECT DISTINCT n_nationkey || '.' || minor || '.0' AS tag
  FROM (SELECT n_nationkey, unnest(range(40)) AS minor FROM nation)
)"""

_REQUESTS = """
requests AS (
  SELECT 'p' || c_custkey AS pipeline_key, c_nationkey || '.' || c_custkey % 40 || '.0' AS release_version,
         c_mktsegment AS reason
  FROM customer
)"""

_BLOCK_TAGS = """
tags AS (SELECT DISTINCT c_custkey % 25 || '.' || c_custkey // 40 || '.0' AS tag FROM customer)"""

_BLOCK_REQUESTS = """
requests AS (
  SELECT 'p' || c_custkey AS pipeline_key, c_nationkey || '.' || c_custkey // 40 || '.0' AS release_version,
         c_mktsegment AS reason
  FROM customer
)"""

_DECISION = """
SELECT tag, count(release_version) AS n_requests,
       CASE count(release_version) WHEN 0 THEN 'SKIP' WHEN 1 THEN 'RUN' ELSE 'FAIL' END AS decision
FROM tags LEFT JOIN requests ON release_version = tag GROUP BY tag"""


def _ledger_sql(shift: int = 0) -> str:
    return f"""
ledger AS (
  SELECT 'a' || event_id AS attempt_id, seq, 'p' || user_id AS pipeline_key,
         '1.' || (event_id + {shift}) % 41 || '.0' AS release_version, props AS reason,
         'user' || user_id % 7 AS tagger,
         CASE WHEN event_id % 5 <> 0 THEN 'lead' || user_id % 3 END AS approver,
         CASE WHEN seq = 2 THEN 'u' || event_id END AS update_id,
         'https://example.org/runs/' || event_id AS run_link,
         CASE WHEN seq = 1 THEN 'TRIGGERING'
              WHEN event_type = 'error' THEN 'FAILED'
              WHEN event_type = 'view' THEN 'OUTCOME UNKNOWN'
              WHEN event_type = 'purchase' THEN 'COMPLETED'
              WHEN event_id % 2 = 0 THEN 'cancelled?' END AS outcome
  FROM events, (VALUES (1), (2)) AS s(seq)
  WHERE seq = 1 OR event_type <> 'click'
)"""


_CURRENT = """
current_rows AS (
  SELECT attempt_id, pipeline_key, release_version, outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id, pipeline_key, release_version
                                     ORDER BY seq DESC) AS place FROM ledger)
  WHERE place = 1
)"""

_NOT_BLOCKED = """
NOT EXISTS (
  SELECT 1 FROM current_rows c
  WHERE c.pipeline_key = r.pipeline_key AND c.release_version = r.release_version
    AND NOT coalesce(c.outcome IN ('FAILED', 'OUTCOME UNKNOWN'), FALSE)
)"""

_EVENT_REQUESTS = """
requests AS (
  SELECT DISTINCT 'p' || user_id AS pipeline_key, '1.' || event_id % 41 || '.0' AS release_version
  FROM events
)"""


def _counts_sql(run: str, table: str, seen: str, dropped: str) -> str:
    return f"""
SELECT '{run}' AS run, '{table}' AS table_name, CAST({seen} AS BIGINT) AS seen,
       CAST({dropped} AS BIGINT) AS dropped FROM raw"""


def _update_counts_sql() -> str:
    lines = []
    for run, rows in (("first", "order_ts < '1996-01-01'"), ("second", "order_ts >= '1996-01-01'"), ("idle", "FALSE")):
        seen = f"count(*) FILTER (WHERE {rows})"
        dropped = f"count(*) FILTER (WHERE {rows} AND order_id IS NULL)"
        lines += [_counts_sql(run, "orders_raw", seen, "0"), _counts_sql(run, "orders_bronze", seen, dropped)]
    return f"WITH {_RAW} " + " UNION ALL ".join(lines)


def _contract_sql() -> str:
    return f"""
        WITH {_CLEANED},
        c(column_name, expected_type, actual_type, conforms) AS (VALUES
          ('order_id', 'string', 'string', TRUE), ('customer_id', 'string', 'string', TRUE),
          ('amount', 'decimal(18,2)', 'decimal(18,2)', TRUE), ('order_ts', 'timestamp', 'timestamp', TRUE),
          ('_processed_at', 'timestamp', 'timestamp', TRUE), ('channel', 'string', 'int', FALSE),
          ('region', 'string', NULL, FALSE)),
        n AS (SELECT count(*) AS n_rows, count(*) - count(order_id) AS i, count(*) - count(customer_id) AS b,
                     count(*) - count(amount) AS a, count(*) - count(order_ts) AS t FROM cleaned)
        SELECT c.*, n_rows, CASE column_name WHEN 'order_id' THEN i WHEN 'customer_id' THEN b WHEN 'amount' THEN a
                            WHEN 'order_ts' THEN t WHEN 'region' THEN NULL ELSE 0 END AS n_nulls
        FROM c, n"""


def _json_text(name: str) -> str:
    return f"""'"{name}":' || coalesce(CAST(to_json({name}) AS VARCHAR), 'null')"""


def _own_sql() -> dict[str, str]:
    fields = "attempt_id seq pipeline_key release_version reason tagger approver update_id run_link outcome"
    record = " || ',' || ".join(_json_text(name) for name in fields.split())
    return {
        "raw_orders": f"WITH {_RAW} SELECT * FROM raw",
        "orders_bronze": _BRONZE,
        "inline_orders": f"""
            {_BRONZE} UNION ALL
            SELECT CAST(id AS VARCHAR), customer_id, TRY_CAST(amount AS DECIMAL(18,2)), CAST(order_ts AS TIMESTAMP)
            FROM (VALUES (1, 'cust-001', '42.50', '2026-08-01 09:15:00'),
                         (2, 'cust-002', '17.99', '2026-08-01 11:42:00'),
                         (3, 'cust-001', '128.00', '2026-08-02 08:03:00'),
                         (4, 'cust-003', 'not-a-number', '2026-08-02 14:20:00'),
                         (NULL, 'cust-004', '99.99', '2026-08-02 16:58:00')) AS s(id, customer_id, amount, order_ts)
            WHERE id IS NOT NULL""",
        "tolerant_amount": f"""
            SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(CASE o_orderkey % 12
                WHEN 0 THEN {_PRICE} WHEN 1 THEN '  ' || {_PRICE} || ' ' WHEN 2 THEN '+' || {_PRICE}
                WHEN 3 THEN '-' || {_PRICE} || '5' WHEN 4 THEN {_PRICE} || '49' WHEN 5 THEN o_custkey || '.'
                WHEN 6 THEN '.' || o_custkey WHEN 7 THEN o_custkey || 'e3' WHEN 8 THEN '$' || {_PRICE}
                WHEN 9 THEN '' WHEN 10 THEN '9999999999999999' || {_PRICE} ELSE 'NaN' END AS DECIMAL(18,2)) AS amount
            FROM orders""",
        "strict_timestamp": """
            SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CASE o_orderkey % 4
                WHEN 0 THEN CAST(o_orderdate AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
                WHEN 2 THEN strftime(o_orderdate, '%Y-%-m-%-d 9:15')
                ELSE strftime(o_orderdate, '%Y-%m-%dT09:15:00Z') END AS TIMESTAMP) AS order_ts
            FROM orders""",
        "processed_at_present": f"WITH {_RAW} SELECT order_id, TRUE AS stamped FROM raw",
        "expectation_counts": f"""
            WITH {_RAW} SELECT count(*) AS seen, count(*) FILTER (WHERE order_id IS NULL) AS dropped,
                               count(*) FILTER (WHERE order_id IS NULL) AS valid_order_id FROM raw""",
        "schema_contract": _contract_sql(),
        "null_count": f"""
            WITH {_CLEANED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE amount IS NULL) AS null_amounts,
                                   CAST(0 AS BIGINT) AS unstamped FROM cleaned""",
        "table_difference": """
            WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
                              CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS order_ts, o_orderkey AS k
                       FROM orders),
            r AS (SELECT order_id, CASE WHEN k % 1000 = 7 THEN '-1' ELSE customer_id END AS customer_id, amount, order_ts
                  FROM l, (VALUES (1), (2), (3)) AS c(copy)
                  WHERE copy <= CASE WHEN k % 1500 = 11 THEN 0 WHEN k % 2000 = 13 THEN 3 ELSE 1 END)
            SELECT order_id, customer_id, amount, order_ts, CAST(sum(a) AS BIGINT) AS left_count,
                   CAST(sum(b) AS BIGINT) AS right_count
            FROM (SELECT order_id, customer_id, amount, order_ts, 1 AS a, 0 AS b FROM l
                  UNION ALL SELECT *, 0, 1 FROM r)
            GROUP BY ALL HAVING sum(a) <> sum(b)""",
        "differing_rows": f"""
            WITH {_CLEANED},
            r AS (SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 1000 = 7 THEN '-1' ELSE customer_id END AS customer_id,
                         amount, order_ts
                  FROM cleaned, (VALUES (1), (2), (3)) AS c(copy)
                  WHERE copy <= CASE WHEN CAST(order_id AS BIGINT) % 1500 = 11 THEN 0 WHEN CAST(order_id AS BIGINT) % 2000 = 13 THEN 3
                                     ELSE 1 END)
            SELECT order_id, customer_id, amount, order_ts, CAST(sum(a) AS BIGINT) AS left_count,
                   CAST(sum(b) AS BIGINT) AS right_count
            FROM (SELECT order_id, customer_id, amount, order_ts, 1 AS a, 0 AS b FROM cleaned
                  UNION ALL SELECT *, 0, 1 FROM r)
            GROUP BY ALL HAVING sum(a) <> sum(b)""",
        "table_difference_repeated_rows": """
            SELECT o_orderstatus, o_orderpriority, CAST(sum(a) AS BIGINT) AS left_count,
                   CAST(sum(b) AS BIGINT) AS right_count
            FROM (SELECT o_orderstatus, o_orderpriority, 1 AS a, 0 AS b FROM orders
                  UNION ALL SELECT l_linestatus, '5-LOW', 0, 1 FROM lineitem)
            GROUP BY ALL HAVING sum(a) <> sum(b)""",
        "table_roundtrip": f"WITH {_RAW} SELECT * FROM raw",
        "raw_to_bronze_tables": _BRONZE,
        "recompute_counts": f"WITH {_RAW}, counts AS ("
        + _counts_sql("recompute", "orders_raw", "count(*)", "0")
        + " UNION ALL "
        + _counts_sql("recompute", "orders_bronze", "count(*)", "count(*) FILTER (WHERE order_id IS NULL)")
        + """)
            SELECT *, CASE table_name WHEN 'orders_raw' THEN 'Orders as they arrived, nothing converted.'
                      ELSE 'Orders with typed columns; rows without an id are dropped.' END AS comment
            FROM counts""",
        "landing_incremental": _BRONZE,
        "landing_forms": f"""
            SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
                   CASE WHEN form IN (0, 1, 4) THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
                   CASE WHEN form IN (0, 1, 2) THEN CAST({_PRICE} AS DECIMAL(18,2)) END AS amount,
                   CASE WHEN form IN (0, 1, 3) THEN o_orderdate END AS order_ts
            FROM (SELECT *, o_orderkey % 8 AS form FROM orders) WHERE form < 5""",
        "update_counts": _update_counts_sql(),
        "update_counts_cut_off": _update_counts_sql(),
        "kept_and_broken": f"""
            WITH {_CLEANED}
            SELECT *, concat_ws(',', CASE WHEN order_id IS NULL THEN 'valid_order_id' END,
                                CASE WHEN amount IS NULL THEN 'priced' END) AS failed FROM cleaned""",
        "steps_out_of_order": f"SELECT * FROM ({_BRONZE}) WHERE amount IS NOT NULL",
        "full_refresh": _BRONZE,
        "refresh_cut_off": f"""
            WITH {_RAW}, runs AS (SELECT * FROM (VALUES (1, 'undone'), (2, 'finished')) v(pointers, outcome)),
            shown AS (SELECT * FROM runs, raw WHERE pointers = 2 OR order_ts < '1996-01-01')
            SELECT pointers, outcome, 'orders_raw' AS table_name, count(*) AS n_rows FROM shown GROUP BY 1, 2
            UNION ALL
            SELECT pointers, outcome, 'orders_bronze', count(order_id) FROM shown GROUP BY 1, 2""",
        "leased_reading": f"""
            WITH {_RAW}, runs AS (SELECT * FROM (VALUES (1, 'before, 0 retired'), (2, 'after, 1 retired')) v(run, reader)),
            shown AS (SELECT * FROM runs, raw WHERE run = 2 OR order_ts < '1996-01-01')
            SELECT reader, 'raw' AS table_name, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers,
                   max(order_ts) AS latest FROM shown GROUP BY 1
            UNION ALL
            SELECT reader, 'bronze', count(*), count(DISTINCT customer_id), max(order_ts)
            FROM shown WHERE order_id IS NOT NULL GROUP BY 1""",
        "release_tags": """
            SELECT DISTINCT o_orderkey % 11 || '.' || o_orderkey % 29 || '.' || o_orderkey % 997 AS tag
            FROM orders WHERE o_orderkey % 7 = 0""",
        "refresh_decision": f"WITH {_TAGS}, {_REQUESTS} {_DECISION}",
        "refresh_decision_many_tags": f"WITH {_BLOCK_TAGS}, {_BLOCK_REQUESTS} {_DECISION}",
        "requested_refreshes": f"""
            WITH {_BLOCK_TAGS}, {_BLOCK_REQUESTS}
            SELECT min(pipeline_key) AS pipeline_key, tag AS release_version, min(reason) AS reason
            FROM tags JOIN requests ON release_version = tag GROUP BY tag HAVING count(*) = 1""",
        "refresh_eligible": f"""
            WITH {_EVENT_REQUESTS},
            current_rows AS (
              SELECT 'p' || user_id AS pipeline_key, '1.' || (event_id + 7) % 41 || '.0' AS release_version,
                     CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'OUTCOME UNKNOWN'
                                     WHEN 'click' THEN 'TRIGGERING' ELSE 'COMPLETED' END AS outcome
              FROM events)
            SELECT pipeline_key, release_version FROM requests r WHERE {_NOT_BLOCKED}""",
        "ledger_current": f"""
            WITH {_ledger_sql()}, {_CURRENT}
            SELECT * REPLACE (CASE WHEN attempt_id NOT IN (
                SELECT attempt_id FROM ledger WHERE seq = 2 AND CAST(substr(attempt_id, 2) AS BIGINT) % 60 = 0)
              THEN outcome END AS outcome) FROM current_rows""",
        "eligible_from_ledger": f"""
            WITH {_ledger_sql(7)}, {_CURRENT}, {_EVENT_REQUESTS}
            SELECT pipeline_key, release_version FROM requests r WHERE {_NOT_BLOCKED}""",
        "ledger_integrity": f"""
            WITH {_ledger_sql()}
            SELECT attempt_id, seq, sha256('{{' || {record} || '}}') AS integrity FROM ledger""",
        "ledger_tampered": f"""
            WITH {_ledger_sql()},
            numbered AS (SELECT *, CAST(substr(attempt_id, 2) AS BIGINT) AS event_id FROM ledger)
            SELECT attempt_id, seq FROM numbered
            WHERE event_id % 50 = 0 OR event_id % 70 = 3 OR event_id % 90 = 4""",
        "ledger_breaks": f"""
            WITH {_ledger_sql()},
            placed AS (SELECT *, CAST(substr(attempt_id, 2) AS BIGINT) AS event_id,
                              row_number() OVER (PARTITION BY pipeline_key ORDER BY attempt_id, seq) AS place,
                              count(*) OVER (PARTITION BY pipeline_key) AS length,
                              count(*) OVER (PARTITION BY pipeline_key, attempt_id) = 2 AS paired FROM ledger),
            gone AS (SELECT *, event_id % 70 = 3 AND seq = 1 OR event_id % 11 = 0 AND place = length AS off,
                            place + CASE WHEN event_id % 90 = 4 AND paired THEN 3 - 2 * seq ELSE 0 END AS position FROM placed),
            chain AS (SELECT * FROM gone WHERE NOT off),
            last AS (SELECT pipeline_key, max(position) AS position, arg_max(place, position) AS place FROM chain GROUP BY pipeline_key)
            SELECT pipeline_key, position, attempt_id, seq, 'the ledger has no such record' AS problem
            FROM chain WHERE event_id % 50 = 0 AND seq = 2
            UNION ALL
            SELECT c.pipeline_key, c.position, c.attempt_id, c.seq, 'does not follow the entry before'
            FROM chain c LEFT JOIN chain b ON b.pipeline_key = c.pipeline_key AND b.position = c.position - 1
            WHERE NOT (c.position = 1 AND c.place = 1 OR coalesce(b.place = c.place - 1, FALSE))
            UNION ALL
            SELECT h.pipeline_key, h.length, NULL, NULL, 'is not where the chain ends'
            FROM (SELECT DISTINCT pipeline_key, length FROM placed) h LEFT JOIN last l USING (pipeline_key)
            WHERE NOT coalesce(l.position = h.length AND l.place = h.length, FALSE)""",
        "approver_default": f"""
            WITH {_ledger_sql()}
            SELECT * REPLACE (coalesce(approver, 'unknown (no pull request found)') AS approver) FROM ledger""",
        "releases_to_run": f"""
            WITH {_BLOCK_TAGS}, {_BLOCK_REQUESTS},
            ledger AS (
              SELECT 'a' || c_custkey AS attempt_id, seq, 'p' || c_custkey AS pipeline_key,
                     c_nationkey || '.' || c_custkey // 40 || '.0' AS release_version,
                     CASE WHEN seq = 1 THEN 'TRIGGERING' WHEN c_mktsegment = 'BUILDING' THEN 'FAILED'
                          WHEN c_mktsegment = 'MACHINERY' THEN 'OUTCOME UNKNOWN' ELSE 'COMPLETED' END AS outcome
              FROM customer, (VALUES (1), (2)) AS s(seq)
              WHERE c_custkey % 3 <> 0 AND (seq = 1 OR c_mktsegment <> 'FURNITURE')),
            {_CURRENT},
            single AS (
              SELECT min(pipeline_key) AS pipeline_key, tag AS release_version
              FROM tags JOIN requests ON release_version = tag GROUP BY tag HAVING count(*) = 1)
            SELECT pipeline_key, release_version FROM single r WHERE {_NOT_BLOCKED}""",
        "governed_refresh": f"""
            WITH {_RAW}
            SELECT seq, 'orders_pipeline' AS pipeline_key, '100.0.1' AS release_version,
                   'landing was put right' AS reason, 'tess' AS tagger,
                   'unknown (no pull request found)' AS approver,
                   CASE seq WHEN 1 THEN 'TRIGGERING' ELSE 'COMPLETED' END AS outcome,
                   (SELECT count(*) FROM raw WHERE order_id IS NOT NULL) AS bronze_rows
            FROM (VALUES (1), (2)) AS s(seq)""",
    }
