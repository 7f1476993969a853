import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SF = "/root/testdata/sf0.001"
SF_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL in DuckDB over the smallest tables."""
    import datetime
    import decimal

    import duckdb

    base = duckdb.connect()
    for table in SF_TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")

    def plain(x):
        if isinstance(x, float):
            return round(x, 6)
        if isinstance(x, decimal.Decimal):
            return float(x)
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None)
        if isinstance(x, list):
            return [plain(v) for v in x]
        return x

    def compare(df, sql):
        names = sorted(df.columns)
        got = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
        found = base.sql(sql)
        columns = list(found.columns)
        assert sorted(columns) == names
        order = [columns.index(n) for n in names]
        expected = sorted((tuple(plain(row[i]) for i in order) for row in found.fetchall()), key=repr)
        assert got == expected

    return compare
