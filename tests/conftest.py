import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagequarry.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def parse(spark):
    """Parse HTML texts into page rows with ids from 1."""
    from pagequarry.operators.dom import parse_pages

    def run(*html, url="https://www.acme-stone.com/a/b?x=1"):
        rows = [(i + 1, url, h) for i, h in enumerate(html)]
        return parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))

    return run


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over literal strings named a, b, c."""

    def run(make, *values):
        names = "abcdef"[: len(values)]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(make(*[df[n] for n in names]).alias("v")).first()["v"]

    return run
