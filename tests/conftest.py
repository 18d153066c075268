import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def compare(spark, data):
    """Runs a query and its SQL twin; both results as sorted lists of rows of strings."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")

    def text(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    def run(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        got = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
        rel = con.execute(sql)
        order = [d[0] for d in rel.description]
        assert sorted(order) == names
        want = sorted(tuple(text(r[order.index(c)]) for c in names) for r in rel.fetchall())
        return got, want

    return run
