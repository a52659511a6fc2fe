from pyspark.sql import functions as F

from lotwise.functions import scoring as S
from lotwise.functions import text as T


def values(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


def test_numbers(spark):
    assert values(spark, T.parse_number, ["2,600", "126K", "1.5M", "0.5", "2,600*", "x2 T1 Commons", "", None]) == [2600, 126000, 1500000, 0.5, 2600, None, None, None]


def test_ranges(spark):
    assert values(spark, T.range_low, ["[1,320 - 1,340]", "[85-100]", "N/A", None]) == [1320, 85, None, None]
    rows = spark.createDataFrame([("1,330", "[1,320 - 1,340]"), ("90", "[85-100]"), ("2,600", "N/A")], "v string, r string")
    assert [r[0] for r in rows.select(T.program_value(F.col("v"), F.col("r"))).collect()] == [1320, 85, 2600]


def test_market_key(spark):
    assert values(spark, T.market_key, ["Icebreaker (Godly Knife)", "MM2 Chroma Luger [Godly]", "C. Fang"]) == ["icebreaker", "chromaluger", "chromafang"]


def test_quantities(spark):
    texts = ["Harvester x2", "3 Icebreaker", "Flowerwood Gun - 4", "Fang", "Phoenix 2", "Seer (x10)", "12"]
    assert values(spark, lambda t: T.split_quantity(t)[1], texts) == [2, 3, 4, 1, 2, 10, 1]
    assert values(spark, lambda t: T.split_quantity(t)[0], texts)[:5] == ["Harvester", "Icebreaker", "Flowerwood Gun", "Fang", "Phoenix"]


def test_rub(spark):
    assert values(spark, T.rub, ["328.98", "34,99", "1 299,50", "1,299.50", "12,345", "1.299,50", "abc", "", None]) == [328.98, 34.99, 1299.5, 1299.5, 12345, 1299.5, None, None, None]


def test_banner(spark):
    rows = spark.createDataFrame([(230, 200, 0), (220, 60, 180), (40, 120, 230), (225, 225, 225), (None, 1, 2)], "r int, g int, b int")
    assert [r[0] for r in rows.select(S.banner_category(F.col("r"), F.col("g"), F.col("b"))).collect()] == ["vintages", "godlies", "rares", "commons", None]


def test_scores_of_nulls(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 20.0D AS twenty, true AS yes, false AS no")
    x, n, yes, no = (F.col(c) for c in ("x", "twenty", "yes", "no"))
    got = row.select(S.offer_score(yes, x, x, x, x, x), S.offer_score(yes, n, x, x, x, x), S.offer_score(no, n, n, x, x, x), S.item_score(x, F.lit("stable"), x), S.back_off(n, F.lit(2), yes)).first()
    assert tuple(got) == (None, 100.0, None, 0.0, 900.0)


def test_range_width_needs_a_plain_range(spark):
    assert values(spark, T.range_width, ["[100 - 150]", "~100 - 150", "150 - 100", "[85]", "1K to 2K", None]) == [0.5, None, None, None, 1.0, None]
