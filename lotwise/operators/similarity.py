"""Similarity queries: votes, sure decisions, learned records, banner colours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def vote_majority(spark, sf_dir):
    """The type with most weight of each user if it leads strictly, else null."""
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    a = v.groupBy("user_id").agg(F.max("n").alias("top"), F.max_by("event_type", F.struct("n", "event_type")).alias("t"), F.sum("n").alias("votes"))
    tied = v.join(a, "user_id").where("n = top").groupBy("user_id").agg(F.count("*").alias("k"))
    return a.join(tied, "user_id").select("user_id", F.when(F.col("k") == 1, F.col("t")).alias("choice"), "votes")


QUERIES["vote_majority"] = vote_majority
ORACLES["vote_majority"] = """
WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, max(n) AS top, sum(n)::BIGINT AS votes FROM v GROUP BY 1)
SELECT m.user_id, CASE WHEN count(*) = 1 THEN max(event_type) END AS choice, any_value(votes) AS votes FROM m JOIN v ON v.user_id = m.user_id AND n = top GROUP BY 1"""


#: A choice is sure from this score and with this lead over the next other one.
SURE, LEAD = 0.80, 0.08


def sure_decision(spark, sf_dir):
    """A user's type is sure if its score (its best value over the best of all) is 0.80 or more, and 0.08 ahead of the next."""
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("value").alias("top"))
    v = e.groupBy("user_id", "event_type").agg(F.max("value").alias("v")).crossJoin(F.broadcast(top)).withColumn("score", F.col("v") / F.col("top"))  # one row
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    r = v.withColumns({"k": F.row_number().over(w), "next": F.lead("score").over(w)}).where("k = 1")
    sure = (F.col("score") >= SURE) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= LEAD)
    return r.select("user_id", F.when(sure, F.col("event_type")).alias("choice"))


QUERIES["sure_decision"] = sure_decision
ORACLES["sure_decision"] = """
SELECT user_id, CASE WHEN score >= 0.8 AND score - coalesce(nx, 0) >= 0.08 THEN event_type END AS choice FROM (
  SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nx FROM (SELECT user_id, event_type, max(value) / (SELECT max(value) FROM events) AS score FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type)) WHERE k = 1"""


def learned_last3(spark, sf_dir):
    """The three newest records of each user and type, which are what is learned."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("event_id", "k")


QUERIES["learned_last3"] = learned_last3
ORACLES["learned_last3"] = "SELECT event_id, k FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS k FROM events) WHERE k <= 3"


def banner_category(spark, sf_dir):
    """Category by colour, from colours made of the part's key and size."""
    p = table(spark, sf_dir, "part")
    r, g, b = (F.pmod(F.col("p_partkey") * k + F.col("p_size"), F.lit(256)) for k in (37, 91, 53))
    return p.select("p_partkey", S.banner_category(r, g, b).alias("category"))


QUERIES["banner_category"] = banner_category
ORACLES["banner_category"] = """
WITH c AS (SELECT p_partkey, (p_partkey * 37 + p_size) % 256 AS r, (p_partkey * 91 + p_size) % 256 AS g, (p_partkey * 53 + p_size) % 256 AS b FROM part),
h AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c),
d AS (SELECT *, CASE WHEN mx = mn THEN 0 WHEN mx = r THEN CASE WHEN g < b THEN 60.0::DOUBLE * (g - b) / (mx - mn)::DOUBLE + 360 ELSE 60.0::DOUBLE * (g - b) / (mx - mn)::DOUBLE END WHEN mx = g THEN 60.0::DOUBLE * (b - r) / (mx - mn)::DOUBLE + 120 ELSE 60.0::DOUBLE * (r - g) / (mx - mn)::DOUBLE + 240 END AS hue FROM h)
SELECT p_partkey, CASE WHEN mx / 255.0::DOUBLE - mn / 255.0::DOUBLE < 0.12 THEN CASE WHEN mx / 255.0::DOUBLE > 0.55 THEN 'commons' END WHEN hue >= 40 AND hue < 70 THEN 'vintages' WHEN hue >= 275 AND hue < 335 THEN 'godlies'
  WHEN hue >= 335 OR hue < 15 THEN 'legendaries' WHEN hue >= 185 AND hue < 255 THEN 'rares' WHEN hue >= 85 AND hue < 165 THEN 'uncommons' END AS category FROM d"""


#: A banner's category is known from this many counts and this share of them; a count is capped.
PRIOR_COUNT, PRIOR_SHARE, COUNT_CAP = 2, 0.8, 1_000_000


def banner_prior(spark, sf_dir):
    """The category that a bucket has been in 80 % of two or more counts."""
    o = table(spark, sf_dir, "part").groupBy((F.col("p_size") * 100 + F.col("p_partkey") % 60).alias("bucket"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("category")).agg(F.least(F.count("*"), F.lit(COUNT_CAP)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("bucket"))
    return o.withColumns({"total": total, "share": F.col("n") / total}).where((F.col("total") >= PRIOR_COUNT) & (F.col("share") >= PRIOR_SHARE)).select("bucket", "category", F.round("share", 9).alias("share"))


QUERIES["banner_prior"] = banner_prior
ORACLES["banner_prior"] = "SELECT bucket, category, round(share, 9) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY bucket) AS total, n / sum(n) OVER (PARTITION BY bucket) AS share FROM (SELECT p_size * 100 + p_partkey % 60 AS bucket, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END AS category, least(count(*), 1000000) AS n FROM part GROUP BY 1, 2)) WHERE total >= 2 AND share >= 0.8"


def shots_merge(spark, sf_dir):
    """Several pictures of one inventory: per item and rank of quantity the largest over the pictures, summed up."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    w = Window.partitionBy("l_suppkey", "l_partkey", "l_orderkey").orderBy(F.desc("q"))
    ranked = li.withColumn("k", F.row_number().over(w))
    return ranked.groupBy("l_suppkey", "l_partkey", "k").agg(F.max("q").alias("q")).groupBy("l_suppkey", "l_partkey").agg(F.sum("q").alias("quantity"))


QUERIES["shots_merge"] = shots_merge
ORACLES["shots_merge"] = """
SELECT l_suppkey, l_partkey, sum(q)::BIGINT AS quantity FROM (SELECT l_suppkey, l_partkey, k, max(q) AS q FROM (
  SELECT l_suppkey, l_partkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_orderkey ORDER BY l_quantity DESC) AS k FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
