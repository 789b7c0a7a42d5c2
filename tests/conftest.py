from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from rolltally.session import configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = configure(
        SparkSession.builder.master("local[4]").appName("rolltally-tests"),
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    ).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Apply a column function to rows of text arguments and list the results."""

    def run(function, rows, schema="a string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"_i long, {schema}")
        columns = [F.col(c) for c in df.columns[1:]]
        return [r["x"] for r in df.select("_i", function(*columns).alias("x")).orderBy("_i").collect()]

    return run
