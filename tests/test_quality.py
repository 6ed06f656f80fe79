from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.operators import (
    VALID_ORDER_ID,
    Expectation,
    column_report,
    contract_violations,
    expect_and_count,
    expect_or_drop,
    expectation_counts,
    null_count,
    require_contract,
    bucket_digests,
    differing_rows,
    require_same_rows,
    table_difference,
    unequal_buckets,
    transform_orders,
)

PRICED = Expectation("priced", "amount > 0")
RAW = "order_id STRING, customer_id STRING, amount STRING, order_ts STRING"


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [("1", 5), ("2", -1), (None, 3), (None, None), ("5", None)], "order_id STRING, amount INT"
    )


def test_rows_not_meeting_a_condition_are_dropped_and_null_is_not_met(items):
    assert [r["order_id"] for r in expect_or_drop(items, VALID_ORDER_ID, PRICED).collect()] == ["1"]
    assert expect_or_drop(items).count() == 5


def test_counts_per_expectation(items):
    row = expectation_counts(items, VALID_ORDER_ID, PRICED).first()
    assert row.asDict() == {"seen": 5, "dropped": 4, "valid_order_id": 2, "priced": 3}


def test_counts_are_taken_while_writing(items, tmp_path):
    observed = Observation()
    kept = expect_and_count(items.repartition(3), observed, [VALID_ORDER_ID, PRICED])
    kept.write.parquet(str(tmp_path / "out"))
    assert observed.get == {"seen": 5, "dropped": 4, "valid_order_id": 2, "priced": 3}
    assert kept.sparkSession.read.parquet(str(tmp_path / "out")).count() == 1


def test_no_expectation_keeps_everything(items):
    observed = Observation()
    assert len(expect_and_count(items, observed, []).collect()) == 5
    assert observed.get == {"seen": 5, "dropped": 0}


def test_a_filter_alone_may_skip_a_bad_cast_but_counting_never_does(spark, tmp_path):
    """Counting fixes the failure rule: the optimizer cannot move the filter below the cast."""
    path = str(tmp_path / "raw")
    spark.createDataFrame([(None, "k", "1", "bad"), ("1", "k", "1", "2025-03-04")], RAW).write.parquet(path)
    cleaned = transform_orders(spark.read.parquet(path))
    assert expect_or_drop(cleaned, VALID_ORDER_ID).count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        expect_and_count(cleaned, Observation(), [VALID_ORDER_ID]).collect()


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("1", "k", "1", "2025-03-04")], RAW).write.parquet(path)
    kept = expect_or_drop(transform_orders(spark.read.parquet(path)), VALID_ORDER_ID)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_id)]" in plan
    assert "Exchange" not in plan


def test_contract(items):
    assert contract_violations(items, {"order_id": "string", "amount": "int"}) == []
    assert contract_violations(items, {"order_id": "string", "amount": "bigint", "ts": "date"}) == [
        "ts: missing",
        "amount: int instead of bigint",
    ]
    assert contract_violations(items, {"order_id": "string"}) == ["amount: not expected"]
    assert require_contract(items, {"order_id": "string", "amount": "int"}) is items
    with pytest.raises(ValueError, match="amount: not expected"):
        require_contract(items, {"order_id": "string"})


def test_column_report(items):
    rows = column_report(items, {"order_id": "string", "amount": "bigint", "ts": "date"}).collect()
    assert [tuple(r) for r in rows] == [
        ("order_id", "string", "string", True, 5, 2),
        ("amount", "bigint", "int", False, 5, 2),
        ("ts", "date", None, False, 5, None),
    ]
    assert null_count(items, "order_id") == 2


PAIRS = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None])), max_size=25
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS, PAIRS)
def test_difference_agrees_with_counting(spark, left, right):
    schema = "k STRING, n INT"
    found = table_difference(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    a, b = Counter(left), Counter(right)
    expected = {row: (a[row], b[row]) for row in a | b if a[row] != b[row]}
    assert {(r["k"], r["n"]): (r["left_count"], r["right_count"]) for r in found.collect()} == expected


def test_difference_matches_columns_by_name(spark):
    left = spark.createDataFrame([(1, "x")], "n INT, k STRING")
    right = spark.createDataFrame([("x", 1)], "k STRING, n INT")
    require_same_rows(left, right)
    with pytest.raises(ValueError, match="columns differ"):
        table_difference(left, right.withColumnRenamed("n", "m"))


def test_unequal_tables_are_reported(spark):
    left = spark.range(10).repartition(3)
    require_same_rows(left, spark.range(9, -1, -1))
    with pytest.raises(AssertionError, match="left_count=2, right_count=1"):
        require_same_rows(left.union(left.filter("id = 3")), left)
    with pytest.raises(AssertionError, match="schemas differ"):
        require_same_rows(left, left.select(F.col("id").cast("int").alias("id")))


def test_difference_shuffles_once(spark):
    plan = table_difference(spark.range(5), spark.range(6))
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert text.count("HashAggregate") == 2
    executed = plan._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


# --- comparison by digests


DIGEST_SCHEMA = "a string, b string, n double, l array<int>, s struct<x: int, y: string>"


def digest_rows(n, seed=1):
    pick = __import__("random").Random(seed)
    words = ["x", "y", "", None]
    return [
        (pick.choice(words), pick.choice(words), pick.choice([0.5, None, float("nan"), 2.0]), pick.choice([None, [], [1, None]]), pick.choice([None, (1, "p"), (None, "p")]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_differing_rows_are_those_of_the_direct_comparison(spark, buckets):
    rows = digest_rows(400)
    left = spark.createDataFrame(rows, DIGEST_SCHEMA).repartition(3)
    for other in (rows, rows[::-1], rows[:-1], rows + rows[:1], digest_rows(400, 2), []):
        right = spark.createDataFrame(other, DIGEST_SCHEMA).select("s", "n", "l", "b", "a")
        found, expected = (sorted(map(str, f.collect())) for f in (differing_rows(left, right, buckets), table_difference(left, right)))
        assert found == expected
    assert differing_rows(left, left, buckets).isEmpty()


def test_values_that_change_places_with_nulls_are_not_overlooked(spark):
    schema = "a string, b string"
    left, right = (spark.createDataFrame(r, schema) for r in ([("v", None), ("w", "w")], [(None, "v"), ("w", "w")]))
    assert differing_rows(left, right).count() == 2
    twice = spark.createDataFrame([("w", "w")] * 2, schema)
    assert differing_rows(twice, twice.limit(1)).collect()[0].asDict() == {"a": "w", "b": "w", "left_count": 2, "right_count": 1}
    assert differing_rows(twice.where("false"), twice.where("false")).isEmpty()


def test_equal_tables_are_not_shuffled_row_by_row(spark, tmp_path):
    spark.range(50_000).selectExpr("id", "string(id) AS t").write.parquet(f"{tmp_path}/a")
    spark.range(49_999, -1, -1).selectExpr("id", "string(id) AS t").write.parquet(f"{tmp_path}/b")
    left, right = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    assert unequal_buckets(left, right, left.columns).isEmpty()
    digests = bucket_digests(left, left.columns)
    plan = digests._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Sort" not in plan
    changed = right.withColumn("t", F.when(F.col("id") == 77, "x").otherwise(F.col("t")))
    assert {r["bucket"] for r in unequal_buckets(left, changed, left.columns).collect()} and unequal_buckets(left, changed, left.columns).count() <= 2
    assert sorted(r.t for r in differing_rows(left, changed).collect()) == ["77", "x"]


def test_columns_named_like_inner_ones_and_maps(spark):
    rows = spark.range(3).selectExpr("id AS bucket", "id AS one", "id AS n", "id AS `a.b`")
    assert differing_rows(rows, rows).isEmpty() and differing_rows(rows, rows.filter("bucket > 0")).count() == 1
