"""Readers and writers of snapshots, on small files."""

import pytest
from pyspark.sql import functions as F

from lotwise.sources import snapshots as S


def test_text_of_any_usual_encoding(spark, tmp_path):
    for name, data in {"a": "Нож".encode("utf-8-sig"), "b": "Нож".encode("utf-16"), "c": "Нож".encode("cp1251"), "d": b"plain", "e": "Нож".encode()}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.read_text_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": "Нож", "b": "Нож", "c": "Нож", "d": "plain", "e": "Нож"}


def test_corrupt_rows_are_set_apart(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"name": "a", "value": 3}\nnot json {\n{"name": "b", "value": "x"}\n{"name": "c", "value": null}\n')
    rows, bad = S.read_rows(spark, f"file://{tmp_path}/rows.json", "name string, value int", F.col("name") != "c")
    assert {(r.name, r.value) for r in rows.collect()} == {("a", 3), ("b", None)}
    S.quarantine(bad, f"file://{tmp_path}/quarantine")
    assert [r.value for r in spark.read.parquet(f"file://{tmp_path}/quarantine").collect()] == ["not json {"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_rows(spark, f"file://{tmp_path}/none.json", "name string")[0].collect()


def test_market_settings(spark):
    raw = spark.createDataFrame([("a", "shop", "https://a.example/", "10", "0.1"), ("b", "sweep", "http://b.example", "90", "1.5"), ("c", "other", "https://c.example", "90", "0"), ("d", "shop", "ftp://d", "90", "0"), (None, "shop", "https://e.example", "x", None)], "name string, kind string, url string, interval string, fee string")
    assert {(r.name, r.interval, r.fee) for r in S.checked_markets(raw).collect()} == {("a", 120, 0.1), ("b", 90, 0.0), (None, 120, 0.0)}


def test_versions_categories_features_and_rates(spark, tmp_path):
    base = f"file://{tmp_path}"
    one = spark.createDataFrame([("x", 1), ("y", 2)], "category string, v int")
    S.publish(one, f"{base}/snap")
    S.publish(one.where("v = 2"), f"{base}/snap")
    assert [r.v for r in S.published(spark, f"{base}/snap").collect()] == [2]
    S.replace_categories(one, f"{base}/cat")
    S.replace_categories(spark.createDataFrame([("y", 7)], "category string, v int"), f"{base}/cat")
    assert {(r.category, r.v) for r in spark.read.parquet(f"{base}/cat").collect()} == {("x", 1), ("y", 7)}
    kind = "key string, src string, url string, feature string, at int"
    got = S.merge_features(spark.createDataFrame([("k", "s", "u", "AAA", 1), ("l", "s", "u", "BBB", 5)], kind), spark.createDataFrame([("k", "s", "u", "CCC", 2), ("l", "s", "u", "DDD", 4), ("m", "s", "u", "bad one", 9), ("l", "s", "w", "EEE", 5)], kind))
    assert {(r.key, r.feature) for r in got.collect()} == {("k", "CCC"), ("l", "EEE")}
    for rate, at in ((90.0, "2024-01-01"), (None, "2024-01-02"), (0.0, "2024-01-03"), (91.5, "2024-01-04")):
        S.append_rate(spark, f"{base}/rates", rate, at)
    assert S.current_rate(spark, f"{base}/rates") == 91.5
