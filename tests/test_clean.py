from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from millrace.functions import Field
from millrace.operators import ORDER_FIELDS, PROCESSED_AT, conform, contract, transform_orders

RAW = "order_id STRING, customer_id STRING, amount STRING, order_ts STRING"


def raw(spark, *rows, schema=RAW):
    return spark.createDataFrame(list(rows), schema)


def test_columns_get_the_declared_types(spark):
    cleaned = transform_orders(raw(spark, ("a1", "k1", "3.25", "2025-03-04 05:06:07")))
    written_out = {
        "order_id": "string",
        "customer_id": "string",
        "amount": "decimal(18,2)",
        "order_ts": "timestamp",
        "_processed_at": "timestamp",
    }
    assert dict(cleaned.dtypes) == contract() == written_out
    assert [f.name for f in cleaned.schema if not f.nullable] == [PROCESSED_AT]


def test_readable_values_are_kept(spark):
    cleaned = transform_orders(
        raw(
            spark,
            ("a1", "k1", "3.25", "2025-03-04 05:06:07"),
            ("a2", "k2", "77.01", "2025-03-05 00:00:00"),
        )
    ).drop(PROCESSED_AT)
    expected = spark.createDataFrame(
        [
            ("a1", "k1", Decimal("3.25"), datetime(2025, 3, 4, 5, 6, 7)),
            ("a2", "k2", Decimal("77.01"), datetime(2025, 3, 5)),
        ],
        "order_id STRING, customer_id STRING, amount DECIMAL(18,2), order_ts TIMESTAMP",
    )
    assertDataFrameEqual(cleaned, expected)


def test_every_row_has_the_same_processing_time(spark):
    rows = [(str(i), "k", "1", "2025-03-04") for i in range(500)]
    cleaned = transform_orders(raw(spark, *rows).repartition(4))
    assert cleaned.filter(F.col(PROCESSED_AT).isNull()).count() == 0
    assert cleaned.select(PROCESSED_AT).distinct().count() == 1


@pytest.mark.parametrize(
    ("text", "amount"),
    [
        ("10.50", "10.50"),
        (" 10.50 ", "10.50"),
        ("+5", "5.00"),
        (".5", "0.50"),
        ("5.", "5.00"),
        ("1e3", "1000.00"),
        ("10.555", "10.56"),
        ("10.545", "10.55"),
        ("-10.555", "-10.56"),
        ("9999999999999999.99", "9999999999999999.99"),
        ("not-a-number", None),
        ("", None),
        ("NaN", None),
        ("1,000.00", None),
        ("$5", None),
        ("0x1F", None),
        ("99999999999999999.99", None),
        (None, None),
    ],
)
def test_amounts(spark, text, amount):
    row = transform_orders(raw(spark, ("a1", "k1", text, "2025-03-04"))).first()
    assert row["amount"] == (None if amount is None else Decimal(amount))
    assert row["order_id"] == "a1"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.decimals(allow_nan=False, allow_infinity=False, places=4).map(str),
            st.text(alphabet="0123456789.+-eE ,$x", max_size=12),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_amounts_agree_with_decimal_arithmetic(spark, texts):
    rows = [(str(i), "k", text, "2025-03-04") for i, text in enumerate(texts)]
    found = {r["order_id"]: r["amount"] for r in transform_orders(raw(spark, *rows)).collect()}
    for i, text in enumerate(texts):
        try:
            exact = Decimal(text.strip())
        except ArithmeticError:
            assert found[str(i)] is None
            continue
        if exact.adjusted() >= 17:
            assert found[str(i)] is None
        elif exact.adjusted() < 15:
            assert found[str(i)] == exact.quantize(Decimal("0.01"), ROUND_HALF_UP)


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("2026-08-01 09:15:00", datetime(2026, 8, 1, 9, 15)),
        ("2026-08-01", datetime(2026, 8, 1)),
        ("2026-8-1 9:15", datetime(2026, 8, 1, 9, 15)),
        ("2026-08-01T09:15:00Z", datetime(2026, 8, 1, 9, 15)),
        ("2026-08-01 09:15:00+02:00", datetime(2026, 8, 1, 7, 15)),
        (None, None),
    ],
)
def test_timestamps(spark, text, moment):
    cleaned = transform_orders(raw(spark, ("a1", "k1", "1", text)))
    assert cleaned.select(F.col("order_ts").cast("timestamp_ntz")).first()[0] == moment


@pytest.mark.parametrize("text", ["bad", "", "2026-02-30"])
def test_an_unreadable_timestamp_fails_the_job(spark, text):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        transform_orders(raw(spark, ("a1", "k1", "1", text))).collect()


def test_numeric_ids_become_text(spark):
    schema = "order_id INT, customer_id BIGINT, amount DOUBLE, order_ts STRING"
    row = transform_orders(raw(spark, (7, 8, 2.5, "2025-03-04"), schema=schema)).first()
    assert (row["order_id"], row["customer_id"], row["amount"]) == ("7", "8", Decimal("2.50"))


def test_other_columns_are_left_out_and_missing_ones_are_an_error(spark):
    df = raw(spark, ("a1", "k1", "1", "2025-03-04"))
    assert transform_orders(df.withColumn("channel", F.lit("web"))).columns == list(contract())
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        transform_orders(df.drop("amount"))


def test_fields_choose_between_failing_and_null(spark):
    df = spark.createDataFrame([("x",)], "n STRING")
    assert conform(df, [Field("n", "int", tolerant=True)]).first()["n"] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(df, [Field("n", "int")]).collect()
    assert [f.name for f in ORDER_FIELDS if f.tolerant] == ["amount"]


def test_cleaning_is_one_narrow_stage(spark):
    plan = transform_orders(raw(spark, ("a1", "k1", "1", "2025-03-04")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    assert text.count("Project") == 1
