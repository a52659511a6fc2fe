"""Queries on names, numbers and quantities in texts; the tables' part names stand in for item names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def K():
    return F.col("p_partkey") % 5


def name_key_norm(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    shown = F.when(K() == 0, F.concat(F.lit("C. "), F.col("p_name"))).when(K() == 1, F.upper("p_name")).when(K() == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit("!\t"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", T.name_key(shown).alias("key"))


QUERIES["name_key_norm"] = name_key_norm
ORACLES["name_key_norm"] = """
SELECT p_partkey, regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN 'chroma ' ELSE '' END || lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part"""


def chroma_name_norm(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_name")
    shown = F.when(K() == 0, F.concat(n, F.lit(" (Chroma)"))).when(K() == 1, F.concat(F.lit("Chroma  "), n)).when(K() == 2, F.concat(F.lit("Хрома - "), n)).when(K() == 3, F.concat(F.lit("Chromatic "), n)).otherwise(n)
    return p.select("p_partkey", T.chroma_name(shown).alias("chroma"))


QUERIES["chroma_name_norm"] = chroma_name_norm
ORACLES["chroma_name_norm"] = "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'Chroma ' || trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS chroma FROM part"


def market_key_norm(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_name")
    shown = F.when(K() == 0, F.concat(n, F.lit(" (Godly Knife)"))).when(K() == 1, F.concat(F.lit("MM2 "), n, F.lit(" [Godly]"))).when(K() == 2, F.concat(F.lit("C. "), n)).when(K() == 3, F.concat(n, F.lit(" Chroma Gun"))).otherwise(F.concat(F.lit("Murder Mystery 2 "), n, F.lit(" pet")))
    return p.select("p_partkey", T.market_key(shown).alias("key"))


QUERIES["market_key_norm"] = market_key_norm
ORACLES["market_key_norm"] = r"""
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (2, 3) THEN 'chroma' ELSE '' END || regexp_replace(regexp_replace(lower(p_name), '\b(roblox|godly|ancient|vintage|legendary|uncommon|common|unique|knife|gun|weapon|item|pet)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM part"""


def parse_price_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    whole = F.floor("p_retailprice")
    shown = F.when(K() == 0, F.concat(F.lit("~ "), F.format_number(whole, 0), F.lit("*"))).when(K() == 1, F.concat(whole.cast("string"), F.lit("K"))).when(K() == 2, F.concat((whole / 10).cast("decimal(12,1)").cast("string"), F.lit(" m"))).when(K() == 3, F.lit("n/a")).otherwise(whole.cast("string"))
    return p.select("p_partkey", T.parse_number(shown).alias("number"))


QUERIES["parse_price_text"] = parse_price_text
ORACLES["parse_price_text"] = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN floor(p_retailprice) WHEN 1 THEN floor(p_retailprice) * 1000 WHEN 2 THEN floor(p_retailprice) * 100000 WHEN 3 THEN NULL ELSE floor(p_retailprice) END::DOUBLE AS number FROM part"""


def range_low_value(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    low, high = F.format_number(F.floor("p_retailprice"), 0), F.format_number(F.floor("p_retailprice") + F.col("p_size"), 0)
    shown = F.when(K() == 0, F.concat(F.lit("["), low, F.lit(" - "), high, F.lit("]"))).when(K() == 1, F.concat(F.lit("~"), low, F.lit(" ~ "), high)).when(K() == 2, F.concat(F.lit("("), low, F.lit(" to "), high, F.lit(")*"))).otherwise(F.lit("N/A"))
    value = F.when(K() == 3, low).otherwise(F.lit("2,600"))
    return p.select("p_partkey", T.range_low(shown).alias("low"), F.round(T.range_width(shown), 6).alias("width"), T.program_value(value, shown).alias("value"))


QUERIES["range_low_value"] = range_low_value
ORACLES["range_low_value"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN floor(p_retailprice) END AS low, CASE WHEN p_partkey % 5 = 0 THEN round(p_size / floor(p_retailprice), 6) END AS width,
  CASE WHEN p_partkey % 5 < 4 THEN floor(p_retailprice) ELSE 2600 END::DOUBLE AS value FROM part"""


def rub_amount(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    whole = F.floor("p_retailprice").cast("long")
    shown = F.when(K() == 0, F.concat(F.format_number(whole, 0), F.lit(".50 ₽"))).when(K() == 1, F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(" ")), F.lit(",25 руб."))).when(K() == 2, F.format_number(whole, 0)).when(K() == 3, F.lit("0 RUB")).otherwise(F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(",75")))
    return p.select("p_partkey", T.rub(shown).alias("rub"))


QUERIES["rub_amount"] = rub_amount
ORACLES["rub_amount"] = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN floor(p_retailprice) + 0.5 WHEN 1 THEN floor(p_retailprice) + 0.25 WHEN 2 THEN floor(p_retailprice) WHEN 3 THEN NULL ELSE floor(p_retailprice) + 0.75 END::DOUBLE AS rub FROM part"""


def qty_grammar(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    n, q, k = F.concat(F.lit("Item "), F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij")), F.col("q").cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    shown = F.when(k == 0, F.concat(n, F.lit(" x"), q)).when(k == 1, F.concat(q, F.lit(" "), n)).when(k == 2, F.concat(n, F.lit(" ("), q, F.lit(")"))).when(k == 3, F.concat(n, F.lit(" - "), q)).when(k == 4, F.concat(F.lit("x"), q, F.lit(" "), n)).otherwise(n)
    name, quantity = T.split_quantity(shown)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name"), quantity.alias("quantity"))


QUERIES["qty_grammar"] = qty_grammar
ORACLES["qty_grammar"] = """
SELECT l_orderkey, l_linenumber, l_partkey, 'Item ' || translate(l_partkey::VARCHAR, '0123456789', 'abcdefghij') AS name,
  CASE WHEN (l_orderkey + l_linenumber) % 6 = 5 THEN 1 ELSE l_quantity END::INTEGER AS quantity FROM lineitem"""


def rarity_category(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = F.when(K() == 0, "Godly").when(K() == 1, "необычный").when(K() == 2, "Classic 2014").when(K() == 3, "Rare").otherwise("unknown")
    kind = F.when(F.col("p_size") % 7 == 0, "Pet").otherwise("gun")
    name = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("C. "), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", T.rarity(word).alias("rarity"), T.expected_category(name, kind, word).alias("category"))


QUERIES["rarity_category"] = rarity_category
ORACLES["rarity_category"] = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'godly' WHEN 1 THEN 'uncommon' WHEN 2 THEN 'vintage' WHEN 3 THEN 'rare' END AS rarity,
  CASE WHEN p_size % 11 = 0 THEN 'chromas' WHEN p_size % 7 = 0 THEN 'pets' ELSE CASE p_partkey % 5 WHEN 0 THEN 'godlies' WHEN 1 THEN 'uncommons' WHEN 2 THEN 'vintages' WHEN 3 THEN 'rares' END END AS category FROM part"""
