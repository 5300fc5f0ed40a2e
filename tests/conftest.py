import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Compare a DataFrame with a query's result in DuckDB, whatever the order of rows and columns."""

    def compare(df, sql):
        cols = sorted(df.columns)
        ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        result = duck.sql(sql)
        assert sorted(result.columns) == cols
        place = [result.columns.index(c) for c in cols]
        theirs = sorted(repr(tuple(r[i] for i in place)) for r in result.fetchall())
        assert ours == theirs

    return compare
