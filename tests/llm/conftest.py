import pytest

from millrace.llm.workers import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
