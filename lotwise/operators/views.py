"""Views of a catalogue and small rules of texts, as functions: filters, sort keys, offer books, hints in scripts, names behind values, pauses and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import back_off
from ..functions.text import _NUM, STABILITIES, squeezed
from ..streaming.rotation import market_items
from .common import table
from .lists import site_time

QUERIES: dict = {}
ORACLES: dict = {}

#: Rows of a market's tab, hints of a script, rouble per dollar where a market has no rate of its own, marks of static files.
TAB_ROWS, HINTS, USUAL_RATE, STATIC = 600, 100, 100.0, r"(?i)\.(?:png|jpe?g|webp|svg|gif|woff2?|css)(?:\?|$)"
#: Columns of an item of a view; a market's price is in dollars, else in roubles.
ITEM = "item long, name string, aliases string, category string, demand double, rarity double, score double, value double, secret boolean, usd double, rub double, lots long, sold long, sales long"
SORT_KEYS = ("name", "category", "demand", "rarity", "liquidity", "value", "price", "lots", "sold", "sales")


def viewed(items: DataFrame, categories: list[str] | None = None, favourites: DataFrame | None = None, query: str = "", secret: bool = True) -> DataFrame:
    """The items of some categories (null: all), of favourites (item), whose name or aliases hold a text in any case, and that are not secret if ``secret`` is false."""
    rows = items if categories is None else items.where(F.col("category").isin(categories))
    if favourites is not None:
        rows = rows.join(favourites.select(F.col("item").alias("_f")).distinct(), F.col("item") == F.col("_f"), "left_semi")
    if query.strip():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "name", "aliases")), F.lit(query.strip().lower())))
    return rows if secret else rows.where(~F.coalesce("secret", F.lit(False)))


def sort_value(key: str, rate: Column | None = None) -> Column:
    """What a view is sorted by; a price in roubles counts by the market's own rate, a secret item has no value."""
    if key not in SORT_KEYS:
        raise ValueError(f"no sort key {key}")
    dollars = F.coalesce(F.col("usd"), F.col("rub") / F.coalesce(rate if rate is not None else F.lit(None).cast("double"), F.lit(USUAL_RATE)))
    special = {"name": F.collate(F.lower("name"), "UNICODE"), "category": F.collate("category", "UNICODE"), "liquidity": F.col("score"), "price": dollars, "value": F.when(~F.coalesce("secret", F.lit(False)), F.col("value"))}
    return special.get(key, F.col(key))


def sorted_view(items: DataFrame, key: str, descending: bool = False, most: int = TAB_ROWS, rate: Column | None = None) -> DataFrame:
    """The first ``most`` items by a key, with their place: missing values last in either direction, equal ones by name, then by item."""
    by = sort_value(key, rate)
    order = [by.desc_nulls_last() if descending else by.asc_nulls_last(), F.collate("name", "UNICODE").asc_nulls_last(), F.col("item")]
    few = items.orderBy(*order).limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows


def api_hints(text: Column, host: str) -> Column:
    """Addresses in a script that look like an interface: of the host (a pattern), of hosts that begin with api, paths below /api/, base addresses; each once, in this order, without static files."""
    rest = r"(?:/[^\s\"'`)<>]*)?"
    kinds = [(rf"(?i)https?://[a-z0-9.-]*(?:{host}){rest}", 0), (rf"(?i)https?://api\.[a-z0-9.-]+{rest}", 0), (r"[\"'`](/api/[A-Za-z0-9_./${}:-]+)[\"'`]", 1), (r"baseURL\s*:\s*[\"'`]([^\"'`]+)[\"'`]", 1)]
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(k)) for p, k in kinds])
    return F.slice(F.filter(F.array_distinct(found), lambda h: ~h.rlike(STATIC)), 1, HINTS)


def split_trailing_name(field: str, value: Column) -> Column:
    """Struct of value and name: the name that stands behind a value on its line ("10 Beta"), null if none does. A name has a Latin letter and 2 to 80 characters."""
    number = rf"[~≈*+]*{_NUM}"
    if field == "stability":
        pattern = rf"(?i)^({'|'.join(STABILITIES)})\s+(\S.*)$"
    elif field in ("value", "range", "demand", "rarity", "change"):
        pattern = rf"(?i)^([\[(]?\s*{number}(?:\s*(?:[-–—]|to)\s*{number})?\s*[\])]?\*?(?:\s*\[[^\]]*\])?)\s+(\S.*)$"
    else:
        return F.struct(value.alias("value"), F.lit(None).cast("string").alias("name"))
    head, name = F.regexp_extract(value, pattern, 1), squeezed(F.regexp_extract(value, pattern, 2))
    cut = F.coalesce((name != "") & name.rlike("[A-Za-z]") & F.length(name).between(2, 80), F.lit(False))
    return F.struct(F.when(cut, head).otherwise(value).alias("value"), F.when(cut, name).alias("name"))


def _items(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    some = lambda n, c: F.when(k % n > 0, c)
    return table(spark, sf_dir, "part").select(
        k.alias("item"), F.col("p_name").alias("name"), F.lower("p_brand").alias("aliases"), F.col("p_type").alias("category"), some(5, (F.col("p_size") % 11).cast("double")).alias("demand"), some(7, (F.col("p_size") % 4).cast("double")).alias("rarity"),
        some(3, (k * 37 % 101).cast("double")).alias("score"), some(11, F.col("p_retailprice").cast("double")).alias("value"), (k % 13 == 0).alias("secret"), F.when(k % 4 == 0, F.col("p_retailprice").cast("double")).alias("usd"), F.when(k % 4 == 1, F.col("p_retailprice").cast("double") * 80).alias("rub"),
        some(6, k % 17).alias("lots"), some(8, k % 19).alias("sold"), some(9, k % 23).alias("sales"),
    )


def catalogue_views(spark, sf_dir: str) -> DataFrame:
    """The first forty of each sort key in both directions, of items that are not secret and have an o in their name or brand."""
    items = viewed(_items(spark, sf_dir), query=" O", secret=False)
    out = None
    for key in SORT_KEYS:
        for descending in (False, True):
            one = sorted_view(items, key, descending, 40).select(F.lit(key).alias("key"), F.lit(descending).alias("descending"), "place", "item")
            out = one if out is None else out.unionByName(one)
    return out


QUERIES["catalogue_views"] = catalogue_views
_SQL_KEYS = {"name": "lower(name)", "category": "category", "demand": "demand", "rarity": "rarity", "liquidity": "score", "value": "value", "price": "coalesce(usd, rub / 100)", "lots": "lots", "sold": "sold", "sales": "sales"}
ORACLES["catalogue_views"] = """
WITH i AS MATERIALIZED (SELECT p_partkey AS item, p_name AS name, p_type AS category, CASE WHEN p_partkey % 5 > 0 THEN p_size % 11 END AS demand, CASE WHEN p_partkey % 7 > 0 THEN p_size % 4 END AS rarity, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 37 % 101 END AS score,
  CASE WHEN p_partkey % 11 > 0 THEN p_retailprice END AS value, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice END AS usd, CASE WHEN p_partkey % 4 = 1 THEN p_retailprice::DOUBLE * 80 END AS rub, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 17 END AS lots, CASE WHEN p_partkey % 8 > 0 THEN p_partkey % 19 END AS sold, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 23 END AS sales
  FROM part WHERE p_partkey % 13 <> 0 AND (contains(lower(p_name), 'o') OR contains(lower(p_brand), 'o')))
""" + " UNION ALL ".join(f"SELECT '{k}' AS key, {str(d).lower()} AS descending, row_number() OVER (ORDER BY {e} {'DESC' if d else 'ASC'} NULLS LAST, name, item)::INTEGER AS place, item FROM i QUALIFY place <= 40" for k, e in _SQL_KEYS.items() for d in (False, True))


def offer_book(spark, sf_dir: str) -> DataFrame:
    """Lots of an item and kind: least price, quantity, sellers, sales of a week by those of thirty days."""
    lots = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"), F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice").cast("double")).otherwise(0.0).alias("price"), F.floor("l_quantity").cast("long").alias("quantity"), F.col("l_suppkey").cast("string").alias("seller"), F.when(F.col("l_tax") > 0, F.floor(F.col("l_tax") * 1000).cast("double")).alias("sold_30d"))
    return market_items(lots)


QUERIES["offer_book"] = offer_book
ORACLES["offer_book"] = """
SELECT l_partkey::VARCHAR AS name, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS kind, min(l_extendedprice::DOUBLE) FILTER (l_linenumber > 1 AND l_extendedprice > 0) AS price, sum(floor(l_quantity))::BIGINT AS stock, count(DISTINCT l_suppkey) AS sellers,
  sum(round_even(floor(l_tax * 1000)::DOUBLE * 7 / 30, 0)) FILTER (l_tax > 0)::BIGINT AS sales_week FROM lineitem GROUP BY 1, 2"""


def back_offs(spark, sf_dir: str) -> DataFrame:
    """Seconds until a market is asked again after failures in a row, blocked or not."""
    wait = back_off((F.col("p_size") * 9 + 30).cast("double"), F.col("p_partkey") % 9 + 1, F.col("p_partkey") % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", wait.alias("wait"))


QUERIES["back_offs"] = back_offs
ORACLES["back_offs"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND w < 900 THEN 900 ELSE w END::DOUBLE AS wait FROM (SELECT p_partkey, CASE WHEN (p_size * 9 + 30) * (1 << (CASE WHEN p_partkey % 9 > 5 THEN 5 ELSE p_partkey % 9 END)::INTEGER) > 1800 THEN 1800 ELSE (p_size * 9 + 30) * (1 << (CASE WHEN p_partkey % 9 > 5 THEN 5 ELSE p_partkey % 9 END)::INTEGER) END AS w FROM part) q"""


def site_times(spark, sf_dir: str) -> DataFrame:
    """Dates of orders as the site writes them, at an hour of their key, as instants."""
    day = F.date_format(F.col("o_orderdate").cast("date"), "MMMM d")
    hour = F.col("o_orderkey") % 20 + 4  # not the hours of a night that occur twice, or never
    text = F.concat(day, F.lit("th, "), F.year(F.col("o_orderdate").cast("date")), F.lit(" at "), F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":05 "), F.when(hour >= 12, "PM").otherwise("AM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(site_time(text).cast("timestamp")).alias("at"))


QUERIES["site_times"] = site_times
ORACLES["site_times"] = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 20 + 4 AS h FROM orders), y AS (SELECT *, make_date(year(d), 3, 1) AS march, make_date(year(d), 11, 1) AS november, make_date(year(d), 4, 1) AS april, make_date(year(d), 10, 31) AS october FROM o),
s AS (SELECT *, CASE WHEN year(d) >= 2007 THEN march + ((7 - dayofweek(march)) % 7 + 7)::INTEGER ELSE april + ((7 - dayofweek(april)) % 7)::INTEGER END AS begins, CASE WHEN year(d) >= 2007 THEN november + ((7 - dayofweek(november)) % 7)::INTEGER ELSE october - dayofweek(october)::INTEGER END AS ends FROM y)
SELECT o_orderkey, (epoch(d) + h * 3600 + 300 + CASE WHEN d >= begins AND d < ends THEN 4 ELSE 5 END * 3600)::BIGINT AS at FROM s"""
