import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import hot


@pytest.fixture(scope="module")
def rows(spark):
    """A key with most rows, a null key, null and repeated values, and times that are null or equal."""
    r = random.Random(5)
    day = datetime.datetime(2024, 1, 1)
    data = [(k, r.choice(["hot", "hot", "hot", "b", None]), day + datetime.timedelta(hours=r.randrange(400)) if r.random() < 0.95 else None, r.choice([None, 0, 1, 1, 2, 7, -3]), "x") for k in range(600)]
    return spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, v long, other string").withColumn("day", F.to_date("ts")).cache()


def _same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cells = lambda d: sorted(map(tuple, d.select(*sorted(d.columns)).collect()), key=str)
    assert cells(got) == cells(want) and cells(want)


def test_lagged(rows):
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = rows.withColumns({"before_ts": F.lag("ts").over(w), "before_v": F.lag("v").over(w)})
    _same(hot.lagged(rows, ["key"], ["ts", "id"], ["ts", "v"], "day"), want)


@pytest.mark.parametrize("descending", [False, True])
def test_running(rows, descending):
    turn = F.desc if descending else F.asc
    w = Window.partitionBy("key").orderBy(turn("ts"), turn("id")).rowsBetween(Window.unboundedPreceding, 0)
    _same(hot.running(rows, ["key"], ["ts", "id"], "v", "day", "sum", descending), rows.withColumn("sum", F.sum("v").over(w)))


def test_trailing(rows):
    at = rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    width = 48 * 3600 * 1_000_000
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-width, 0)
    _same(hot.trailing(at, ["key"], "t", width, {"sum": F.col("v")}), at.withColumn("sum", F.sum("v").over(w)))


def test_upper_median(rows):
    w = Window.partitionBy("key")
    ranked = rows.where("v IS NOT NULL").withColumns({"k": F.row_number().over(w.orderBy("v")), "n": F.count("*").over(w)})
    _same(hot.upper_median(rows, ["key"], "v", "m"), ranked.where("k = floor(n / 2) + 1").select("key", F.col("v").alias("m")))


def test_empty_tables(rows):
    none = rows.where("false")
    assert hot.lagged(none, ["key"], ["ts", "id"], ["v"], "day").count() == 0
    assert hot.running(none, ["key"], ["ts", "id"], "v", "day", "sum").count() == 0
    assert hot.trailing(none, ["key"], "id", 5, {"sum": F.col("v")}).count() == 0
    assert hot.upper_median(none, ["key"], "v", "m").count() == 0
