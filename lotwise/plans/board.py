"""The item board: items against market offers, scored and levelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def item_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part: the lowest unit price and lots of each supplier's offers, the mean of the suppliers' liquidity scores, and its level."""
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    offers = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    fold = offers.groupBy("l_partkey", "l_suppkey").agg(F.min(F.expr("l_extendedprice / nullif(l_quantity, 0)")).alias("price"), F.sum("l_quantity").alias("lots"))
    score = F.bround(F.least(F.lit(100.0), 20 * F.log2(1 + F.col("lots"))), 0)
    market = fold.groupBy("l_partkey").agg(F.min("price").alias("price"), F.sum("lots").alias("lots"), F.bround(F.avg(score), 0).alias("score"), F.count("*").alias("markets"))
    level = F.when(F.col("score").isNull(), "none").when(F.col("score") >= 60, "liquid").when(F.col("score") >= 30, "medium").otherwise("illiquid")
    return items.join(market, items.p_partkey == market.l_partkey, "left").select("p_partkey", "p_name", "p_type", "price", "lots", "score", F.coalesce("markets", F.lit(0)).cast("long").alias("markets"), level.alias("level"))


QUERIES["item_board"] = item_board
ORACLES["item_board"] = """
WITH f AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / nullif(l_quantity, 0)) AS price, sum(l_quantity) AS lots FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_partkey, min(price) AS price, sum(lots) AS lots,
             round_even(avg(round_even(least(100.0, 20 * log2(1 + lots)), 0)), 0) AS score, count(*) AS markets FROM f GROUP BY 1)
SELECT p_partkey, p_name, p_type, price, lots, score, coalesce(markets, 0)::BIGINT AS markets,
       CASE WHEN score IS NULL THEN 'none' WHEN score >= 60 THEN 'liquid' WHEN score >= 30 THEN 'medium' ELSE 'illiquid' END AS level
FROM part LEFT JOIN m ON p_partkey = l_partkey
"""
