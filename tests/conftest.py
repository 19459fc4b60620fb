"""One Spark session for all tests."""

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
    session = builder.config("spark.checkpoint.dir", f"file://{folder}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
