import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_lines(spark):
    """Files given as {path: [line, ...]} or one list of lines."""

    def build(files):
        if isinstance(files, list):
            files = {"a.txt": files}
        rows = [(p, i, x) for p, ls in files.items() for i, x in enumerate(ls)]
        return spark.createDataFrame(rows, "path string, line_no bigint, line string")

    return build
