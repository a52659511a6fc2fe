"""Writers of one catalogue: by turns, at once, and one that ends in the middle."""

import threading

import pytest
from pyspark.sql import functions as F

from lotwise.sources import versions
from lotwise.sources.versions import Manifests, Version, commit, current_version, read_version

ITEM = "category string, name string, value int"


def rows_of(df):
    return sorted((str(r.category), r.name, r.value) for r in df.collect())


@pytest.fixture(params=["{}", "file://{}", "{}/a b#%41"])
def folder(request, tmp_path):
    return request.param.format(tmp_path)


def test_two_writers_that_read_the_same_version(spark, folder):
    items = lambda *x: spark.createDataFrame(list(x), ITEM)
    first, out = commit(items(("pets", "Cat", 1), ("guns", "Ray", 2), (None, "Odd", 3)), folder, Version())
    assert first.number == 1 and out == []
    a, b = current_version(spark, folder), current_version(spark, folder)
    second, out = commit(items(("pets", "Cat", 10), ("pets", "Dog", 11)), folder, a)  # the first of the two
    assert second.number == 2 and out == []
    third, out = commit(items(("pets", "Cat", 99), ("guns", "Ray", 20), ("knives", "Saw", 5)), folder, b)
    assert third.number == 3 and out == ["pets"]  # changed meanwhile; the rest is in
    assert rows_of(read_version(spark, folder)) == [("None", "Odd", 3), ("guns", "Ray", 20), ("knives", "Saw", 5), ("pets", "Cat", 10), ("pets", "Dog", 11)]
    assert rows_of(read_version(spark, folder, 1)) == [("None", "Odd", 3), ("guns", "Ray", 2), ("pets", "Cat", 1)]  # versions stay
    same, out = commit(items(("pets", "Cat", 5)), folder, b)
    assert same.number == 3 and out == ["pets"] and current_version(spark, folder) == third
    empty, out = commit(items().limit(0), folder, third, replaced=["guns", None])
    assert rows_of(read_version(spark, folder)) == [("knives", "Saw", 5), ("pets", "Cat", 10), ("pets", "Dog", 11)]
    assert commit(items().limit(0), folder, empty) == (empty, [])


def test_a_writer_that_ends_before_the_rename(spark, folder, monkeypatch):
    old, _ = commit(spark.createDataFrame([("pets", "Cat", 1)], ITEM), folder, Version())

    def ends(self, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Manifests, "create", ends)
        commit(spark.createDataFrame([("pets", "Cat", 2)], ITEM), folder, old)
    assert current_version(spark, folder) == old and rows_of(read_version(spark, folder)) == [("pets", "Cat", 1)]
    assert commit(spark.createDataFrame([("pets", "Cat", 3)], ITEM), folder, old)[0].number == 2


def test_no_category_is_lost_among_many_writers(spark, tmp_path):
    folder, read = str(tmp_path), Version()
    told, wait = {}, threading.Barrier(6)

    def writer(k):
        rows = spark.range(50).select(F.lit(f"c{k % 5}").alias("category"), F.lit(f"w{k}").alias("name"), F.col("id").cast("int").alias("value"))
        wait.wait()
        told[k] = commit(rows, folder, read)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = read_version(spark, folder).groupBy("category").agg(F.count("*").alias("n"), F.collect_set("name").alias("by")).collect()
    assert {r.category: r.n for r in got} == {f"c{k}": 50 for k in range(5)} and all(len(r.by) == 1 for r in got)
    assert sorted(len(out) for _, out in told.values()) == [0, 0, 0, 0, 0, 1]  # the two of c0: one was late
    assert current_version(spark, folder).number == 5


def test_names_that_are_no_manifests(spark, tmp_path):
    commit(spark.createDataFrame([("a", "x", 1)], ITEM), str(tmp_path), Version())
    (tmp_path / "versions" / ".new-left").write_text("{")
    assert current_version(spark, str(tmp_path)).number == 1
    with pytest.raises(ValueError, match="empty"):
        read_version(spark, str(tmp_path / "other"))
    assert versions.current_version(spark, str(tmp_path / "other")) == Version()
