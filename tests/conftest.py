import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as from '{DATA}/sf0.001/{t}.parquet'")
    return c


def canonical(rows):
    """Rows as sorted tuples of text, numbers to nine digits."""

    def cell(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)
