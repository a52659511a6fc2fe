import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same(spark):
    """Compares a query with its SQL on the smallest tables."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def plain(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return ""
        if type(v).__module__ == "numpy":
            v = v.item()
        return f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    def compare(query, sql):
        got, want = query(spark, folder).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
        assert rows(got) == rows(want)

    return compare
