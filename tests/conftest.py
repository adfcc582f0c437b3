import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows(spark):
    """Rows of a frame as sorted tuples."""

    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return get


@pytest.fixture
def value(spark):
    """The value of a column function for one input."""
    from pyspark.sql import functions as F

    def get(function, *inputs, types=None):
        types = types or ["string"] * len(inputs)
        schema = ", ".join(f"c{i} {t}" for i, t in enumerate(types))
        df = spark.createDataFrame([tuple(inputs)], schema)
        return df.select(function(*[F.col(f"c{i}") for i in range(len(inputs))]).alias("x")).first()["x"]

    return get
