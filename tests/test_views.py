"""Views and small rules by hand."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import views

ROW = dict.fromkeys([c.split()[0] for c in views.ITEM.split(", ")])


def items(spark, *rows):
    return spark.createDataFrame([tuple((ROW | {"item": k} | r).values()) for k, r in enumerate(rows)], views.ITEM)


def order(spark, rows, key, descending=False, **more):
    return [r.item for r in views.sorted_view(items(spark, *rows), key, descending, **more).orderBy("place").collect()]


def test_missing_values_are_last_in_both_directions(spark):
    rows = [{"name": "b", "demand": 2.0}, {"name": "C", "demand": None}, {"name": "a", "demand": 2.0}, {"name": "d", "demand": 5.0}, {"name": "A", "demand": None}]
    assert order(spark, rows, "demand") == [2, 0, 3, 4, 1] and order(spark, rows, "demand", True) == [3, 2, 0, 4, 1]
    assert order(spark, rows, "name") == [2, 4, 0, 1, 3] and order(spark, rows, "name", most=2) == [2, 4]
    prices = [{"name": "a", "usd": 2.0}, {"name": "b", "rub": 100.0}, {"name": "c"}, {"name": "d", "usd": 1.5, "rub": 9_000.0}]
    assert order(spark, prices, "price") == [1, 3, 0, 2] and order(spark, prices, "price", rate=F.lit(40.0)) == [3, 0, 1, 2]
    assert order(spark, [{"name": "a", "value": 9.0, "secret": True}, {"name": "b", "value": 1.0}], "value", True) == [1, 0]
    with pytest.raises(ValueError):
        views.sort_value("colour")


def test_filters(spark):
    table = items(spark, {"name": "Ice Wing", "aliases": "IW", "category": "x"}, {"name": "Seer", "aliases": None, "category": "y"}, {"name": "Bat", "aliases": "wing", "category": "x", "secret": True}, {"name": None, "category": None})
    ids = lambda **k: sorted(r.item for r in views.viewed(table, **k).collect())
    assert ids() == [0, 1, 2, 3] and ids(query=" WING ") == [0, 2] and ids(query="iw", categories=["x"]) == [0] and ids(categories=["x"], secret=False) == [0]
    assert ids(favourites=spark.createDataFrame([(1,), (1,), (None,)], "item long"), secret=False) == [1]


def test_hints_of_scripts(spark):
    text = """fetch("https://www.market.gg/v1/x?y=1"); fetch('/api/lots/${id}'); a="https://api.other.com/z"; b="https://market.gg/logo.PNG?v=2"; c={baseURL: "https://m.gg/base"}; fetch("https://www.market.gg/v1/x?y=1"); d="https://market.gg" """
    got = spark.createDataFrame([(text,), (None,)], "t string").select(views.api_hints(F.col("t"), r"market\\.gg".replace("\\\\", "\\"))).collect()
    assert got[0][0] == ["https://www.market.gg/v1/x?y=1", "https://market.gg", "https://api.other.com/z", "/api/lots/${id}", "https://m.gg/base"] and got[1][0] == []
    many = " ".join(f'"/api/{k}"' for k in range(150))
    assert len(spark.createDataFrame([(many,)], "t string").select(views.api_hints(F.col("t"), "nowhere")).first()[0]) == 100


def test_names_behind_values(spark):
    cases = {"10 Beta": ("10", "Beta"), "[1,320 - 1,340] Ice Wing": ("[1,320 - 1,340]", "Ice Wing"), "126K": ("126K", None), "10 20": ("10 20", None), "~5 [4 - 6] C. Seer": ("~5 [4 - 6]", "C. Seer"), "7 x": ("7 x", None), None: (None, None), "1.5M Elder": ("1.5M", "Elder")}
    got = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string").orderBy("k").select(views.split_trailing_name("value", F.col("t")).alias("x")).collect()
    assert [(r.x.value, r.x.name) for r in got] == list(cases.values())
    one = spark.createDataFrame([("Doing Well Seer", "Old 5 Bat")], "s string, o string").select(views.split_trailing_name("stability", F.col("s")).alias("a"), views.split_trailing_name("origin", F.col("o")).alias("b")).first()
    assert tuple(one.a) == ("Doing Well", "Seer") and tuple(one.b) == ("Old 5 Bat", None)
