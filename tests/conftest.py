import pytest
from pyspark.sql import SparkSession

from millrace.session import SETTINGS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("millrace-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.driver.memory", "4g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def database(spark, tmp_path):
    """A database of the test's own, with its files below the test's folder."""
    name = "t_" + tmp_path.name.replace("-", "_").lower()[-40:] + str(abs(hash(str(tmp_path))))[:6]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    return name
