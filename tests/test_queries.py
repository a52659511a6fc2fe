import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lotwise import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_gives_the_rows_of_the_batch(spark):
    d = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, registry.QUERIES[q](spark, d).collect()), key=str) for q in ("stock_delta", "stock_delta_stream"))
    assert a == b


def test_stream_of_a_large_item_out_of_order(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hot = spark.range(5000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 7919 % 503).cast("double").alias("value"), F.lit("").alias("props"))
    assert hot.columns == events.columns
    hot.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        a, b = (sorted(map(tuple, registry.QUERIES[q](spark, str(tmp_path)).collect()), key=str) for q in ("stock_delta", "stock_delta_stream"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(b) == 5000 and a == b


def test_stream_state_over_batches(spark, tmp_path):
    from lotwise.streaming.stock import stream_changes

    schema = "event_id long, user_id long, event_type string, ts timestamp, stock long"
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC)
    first = [(1, 1, "a", at(0), 10), (3, 1, "a", at(200), 4), (2, 1, "a", at(100), 12), (4, 2, "a", at(0), 5)]
    second = [(6, 1, "a", at(400), 9), (5, 1, "a", at(300), 3), (7, 1, "a", at(150), 99), (8, 2, "a", at(90_000), 1), (9, 3, "a", at(0), 2)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 * (1 - k))  # files are taken by age
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, stream_changes(source, f"{tmp_path}/out").collect()))
    assert got == [(1, 10, None, None), (2, 12, 0, 2), (3, 4, 8, 0), (4, 5, None, None), (5, 3, 1, 0), (6, 9, 0, 6), (8, 1, None, None), (9, 2, None, None)]


def test_greedy_assignment(spark):
    from lotwise.operators.matching import greedy_pairs

    rows = [(1, 1, 10, 0.5), (1, 1, 11, 0.1), (1, 2, 11, 0.2), (1, 2, 10, 0.9), (1, 3, 10, None), (2, 1, 10, 0.3)]
    got = greedy_pairs(spark.createDataFrame(rows, "g long, i long, j long, fit double")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 0.3), (1, 11, 0.1), (2, 10, 0.9)]


def test_greedy_assignment_without_a_frame_per_group(spark, monkeypatch):
    from pyspark.sql import GroupedData

    from lotwise.operators.matching import greedy_pairs

    def frame(*_):
        raise AssertionError("a group in one frame")

    monkeypatch.setattr(GroupedData, "applyInPandas", frame)
    r = random.Random(2)
    # ties, a chain in which each pair waits for the one before, and a group without a name
    rows = [(g, r.randrange(12), r.randrange(15), float(r.randrange(6))) for g in (1, 2, None) for _ in range(80)] + [(3, k // 2, (k + 1) // 2, float(k)) for k in range(12)]
    want, used = [], set()
    for g, i, j, fit in sorted(rows, key=lambda x: (x[3], x[1], x[2])):
        if not used & {(g, "i", i), (g, "j", j)}:
            used |= {(g, "i", i), (g, "j", j)}
            want.append((i, j, fit))
    got = greedy_pairs(spark.createDataFrame(rows, "g long, i long, j long, fit double"))
    assert got.dtypes == [("i", "bigint"), ("j", "bigint"), ("fit", "double")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert greedy_pairs(spark.createDataFrame([], "g long, i long, j long, fit double")).count() == 0


def test_stream_state_ends_and_late_rows_are_set_apart(spark):
    from lotwise.streaming import stock

    day = 86_400_000_000
    rows = lambda x: spark.createDataFrame(x, "user_id long, event_type string, event_id long, us long, stock long")
    held = spark.createDataFrame([(1, "a", 10 * day, 1, 5), (2, "a", 1 * day, 2, 7)], stock.STATE)
    out, last, late = stock.batch_changes(rows([(1, "a", 3, 10 * day + 60, 2), (1, "a", 4, 9 * day, 9)]), held)
    assert [(r.event_id, r.sold, r.listed) for r in out.collect()] == [(3, 3, 0)]
    assert [r.event_id for r in late.collect()] == [4]
    assert {(r.user_id, r.stock) for r in last.collect()} == {(1, 2)}  # item 2 is out of date by more than a snapshot can refer to
