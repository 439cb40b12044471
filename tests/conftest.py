import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("gradeframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="gradeframe-test-")


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate columns over a list of texts."""
    def run(texts, *columns, name="t"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], f"i int, {name} string")
        rows = df.repartition(8).select("i", *columns).collect()
        return [r[1:] if len(columns) > 1 else r[1] for r in sorted(rows, key=lambda r: r[0])]

    return run
