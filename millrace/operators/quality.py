"""Named expectations on rows, and checks on whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """A named SQL condition that rows must meet. NULL counts as not met."""

    name: str
    condition: str

    def __post_init__(self) -> None:
        if self.name in ("seen", "dropped"):
            raise ValueError(f"{self.name!r} is the name of a total and cannot name an expectation")

    def met(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))


VALID_ORDER_ID = Expectation("valid_order_id", "order_id IS NOT NULL")


def _all_met(expectations: Sequence[Expectation]) -> Column:
    return reduce(lambda left, right: left & right, (e.met() for e in expectations), F.lit(True))


def _counts(expectations: Sequence[Expectation]) -> list[Column]:
    each = [F.count_if(~e.met()).alias(e.name) for e in expectations]
    dropped = F.count_if(~_all_met(expectations)).alias("dropped")
    return [F.count(F.lit(1)).alias("seen"), dropped, *each]


def expect_or_drop(df: DataFrame, *expectations: Expectation) -> DataFrame:
    """Rows that meet every expectation.

    The conditions stay plain filters, so they reach the scan when they can.
    """
    return reduce(lambda rows, e: rows.filter(F.expr(e.condition)), expectations, df)


def expect_and_count(
    df: DataFrame, observation: Observation | str, expectations: Sequence[Expectation]
) -> DataFrame:
    """As ``expect_or_drop``, counting seen and dropped rows on the way.

    The counting needs every row as it was before the filter. It therefore also
    makes every strict cast run, on rows that will be dropped as well.
    """
    return df.observe(observation, *_counts(expectations)).filter(_all_met(expectations))


FAILED_EXPECTATIONS = "_failed"


def broken_rows(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """The rows ``expect_or_drop`` leaves out, each with the names of what it fails in ``_failed``."""
    if FAILED_EXPECTATIONS in df.columns:
        raise ValueError(f"a column is called {FAILED_EXPECTATIONS} already")
    names = F.array_compact(F.array(*(F.when(~e.met(), F.lit(e.name)) for e in expectations))).cast("array<string>")
    return df.withColumn(FAILED_EXPECTATIONS, names).filter(~_all_met(expectations))


def expectation_counts(df: DataFrame, *expectations: Expectation) -> DataFrame:
    """One row: rows seen, rows dropped, and rows failing each expectation."""
    return df.agg(*_counts(expectations))


def contract_violations(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """How the columns of ``df`` differ from the expected names and types."""
    actual = dict(df.dtypes)
    missing = [f"{name}: missing" for name in expected if name not in actual]
    extra = [f"{name}: not expected" for name in actual if name not in expected]
    retyped = [
        f"{name}: {actual[name]} instead of {data_type}"
        for name, data_type in expected.items()
        if actual.get(name, data_type) != data_type
    ]
    return missing + extra + retyped


def require_contract(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """``df`` itself, after its columns were compared with the contract."""
    if problems := contract_violations(df, expected):
        raise ValueError("schema contract broken: " + "; ".join(problems))
    return df


def column_report(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per expected column: types, whether they agree, rows and NULLs.

    One pass with a single global aggregate, whatever the number of columns.
    """
    actual = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.struct(
            *(
                (F.count_if(F.col(name).isNull()) if name in actual else F.lit(None).cast("long")).alias(name)
                for name in expected
            )
        ).alias("nulls"),
    )
    lines = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(data_type).alias("expected_type"),
            F.lit(actual.get(name)).cast("string").alias("actual_type"),
            F.lit(actual.get(name) == data_type).alias("conforms"),
            F.col("n_rows"),
            F.col("nulls")[name].alias("n_nulls"),
        )
        for name, data_type in expected.items()
    ]
    return counts.select(F.inline(F.array(*lines)))


def null_count(df: DataFrame, column: str) -> int:
    return df.filter(F.col(column).isNull()).count()
