import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def comparable(frame):
    """Rows as sorted tuples of text, columns by name."""
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)

    def one(x):
        if x is None or isinstance(x, (str, bool)):
            return str(x)
        return repr(float(x)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return columns, sorted(tuple(map(one, r)) for r in rows.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows():
    def check(a, b):
        (columns_a, rows_a), (columns_b, rows_b) = comparable(a), comparable(b)
        assert columns_a == columns_b
        assert len(rows_a) == len(rows_b)
        assert rows_a == rows_b

    return check
