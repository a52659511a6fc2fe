"""Catalogue queries: filters, search, semi and anti joins, summaries, replacement and the acceptance check of a new load."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from .common import table
from .hot import running

QUERIES: dict = {}
ORACLES: dict = {}


#: An item of at least this value is secret.
SECRET = 1_000_000


def secret_placeholder_filter(spark, sf_dir):
    """Items that are neither secret (a value of a million or more) nor placeholders (neither demand nor rarity)."""
    p = table(spark, sf_dir, "part").withColumns({"value": F.col("p_retailprice") * 800, "demand": F.when(F.col("p_size") % 4 > 0, F.col("p_size")), "rarity": F.when(F.col("p_partkey") % 3 > 0, F.col("p_size"))})
    secret = F.coalesce(F.col("value") >= SECRET, F.lit(False))
    return p.where(~secret & ~(F.col("demand").isNull() & F.col("rarity").isNull())).select("p_partkey", "p_name", "p_retailprice")


QUERIES["secret_placeholder_filter"] = secret_placeholder_filter
ORACLES["secret_placeholder_filter"] = "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice * 800 < 1000000 AND (p_size % 4 > 0 OR p_partkey % 3 > 0)"


def catalog_view_search(spark, sf_dir):
    """The fifty dearest items of a type whose name holds a text; items without value last."""
    p = table(spark, sf_dir, "part").withColumn("value", F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")))
    return p.where(F.lower("p_name").contains("e") & (F.col("p_size") > 5)).orderBy(F.desc_nulls_last("value"), "p_name", "p_partkey").limit(50).select("p_partkey", "p_name", "value")


QUERIES["catalog_view_search"] = catalog_view_search
ORACLES["catalog_view_search"] = """
SELECT p_partkey, p_name, CASE WHEN p_size % 9 <> 0 THEN p_retailprice END AS value FROM part WHERE contains(lower(p_name), 'e') AND p_size > 5
ORDER BY value DESC NULLS LAST, p_name, p_partkey LIMIT 50"""


def hidden_secret_count(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count_if(F.col("p_size") % 13 == 0).alias("hidden"), F.count("*").alias("items"))


QUERIES["hidden_secret_count"] = hidden_secret_count
ORACLES["hidden_secret_count"] = "SELECT p_type, count(*) FILTER (p_size % 13 = 0) AS hidden, count(*) AS items FROM part GROUP BY p_type"


def favorites_semi(spark, sf_dir):
    """Items that customers of one segment have ordered."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_semi")


QUERIES["favorites_semi"] = favorites_semi
ORACLES["favorites_semi"] = "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')"


def unmatched_offers_anti(spark, sf_dir):
    """Offers of no item of the list, counted for each market."""
    p = table(spark, sf_dir, "part").where("p_size % 3 <> 0").select("p_partkey")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti").groupBy("l_suppkey").agg(F.count("*").alias("unmatched"))


QUERIES["unmatched_offers_anti"] = unmatched_offers_anti
ORACLES["unmatched_offers_anti"] = "SELECT l_suppkey, count(*) AS unmatched FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 <> 0) GROUP BY 1"


def category_summary(spark, sf_dir):
    """Items, dearest and mean value of each region's nations; those without suppliers as well."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    a = s.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))
    return n.join(a, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("items"), "top", F.col("n").isNull().alias("empty"))


QUERIES["category_summary"] = category_summary
ORACLES["category_summary"] = "SELECT n_nationkey, n_name, count(s_suppkey) AS items, max(s_acctbal) AS top, count(s_suppkey) = 0 AS empty FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1, 2"


def _scored(spark, sf_dir):
    words = list(S.STABILITY)
    stability = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    demand = F.when(F.col("p_size") % 17 != 0, F.col("p_size") % 12)
    width = (F.col("p_size") % 10) / 40.0
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", S.item_score(demand, stability, width).alias("score"))


_SCORED = f"""SELECT p_partkey, p_type, round_even(greatest(0.0, least(100.0, coalesce(CASE WHEN p_size % 17 <> 0 THEN least(10, p_size % 12) * 10 END, 0)
  + list_extract({list(S.STABILITY.values())}, (p_partkey % {len(S.STABILITY)} + 1)::INTEGER)
  + CASE WHEN (p_size % 10) / 40.0 <= 0.05 THEN 5 WHEN (p_size % 10) / 40.0 > 0.2 THEN -5 ELSE 0 END)), 0)::DOUBLE AS score FROM part"""
_LEVEL = "CASE WHEN score IS NULL THEN 'none' WHEN score >= 60 THEN 'liquid' WHEN score >= 30 THEN 'medium' ELSE 'illiquid' END"


def liquidity_item_score(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("level", S.level(F.col("score")))


QUERIES["liquidity_item_score"] = liquidity_item_score
ORACLES["liquidity_item_score"] = f"SELECT *, {_LEVEL} AS level FROM ({_SCORED})"


def liquidity_levels(spark, sf_dir):
    return liquidity_item_score(spark, sf_dir).groupBy("level").agg(F.count("*").alias("items"), F.avg("score").alias("mean"))


QUERIES["liquidity_levels"] = liquidity_levels
ORACLES["liquidity_levels"] = f"SELECT {_LEVEL} AS level, count(*) AS items, avg(score) AS mean FROM ({_SCORED}) GROUP BY 1"


def liquidity_top_per_level(spark, sf_dir):
    """The 300 best of each level."""
    w = Window.partitionBy("level").orderBy(F.desc("score"), "p_partkey")
    return liquidity_item_score(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 300").select("p_partkey", "level", "score", "place")


QUERIES["liquidity_top_per_level"] = liquidity_top_per_level
ORACLES["liquidity_top_per_level"] = f"SELECT p_partkey, level, score, place FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, p_partkey)::INTEGER AS place FROM (SELECT *, {_LEVEL} AS level FROM ({_SCORED}))) WHERE place <= 300"


def category_replace(spark, sf_dir):
    """A new load of some categories replaces all their rows, the others stay."""
    old = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_retailprice").alias("value"))
    new = table(spark, sf_dir, "part").where("p_size % 2 = 0 AND p_type LIKE 'S%'").select("p_partkey", "p_type", (F.col("p_retailprice") + 1).alias("value"))
    return old.join(new.select("p_type").distinct(), "p_type", "left_anti").select("p_partkey", "p_type", "value").unionByName(new)


QUERIES["category_replace"] = category_replace
ORACLES["category_replace"] = """
WITH new AS (SELECT p_partkey, p_type, p_retailprice + 1 AS value FROM part WHERE p_size % 2 = 0 AND p_type LIKE 'S%')
SELECT p_partkey, p_type, p_retailprice AS value FROM part WHERE p_type NOT IN (SELECT p_type FROM new) UNION ALL SELECT * FROM new"""


def trust_check(spark, sf_dir):
    """A new load of a category is accepted unless it lost more than half of a category of at least ten items."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("old"), F.count_if(F.col("p_size") % 5 < F.col("p_partkey") % 5).alias("new")).withColumn("accepted", (F.col("old") < 10) | (F.col("new") * 2 >= F.col("old")))


QUERIES["trust_check"] = trust_check
ORACLES["trust_check"] = "SELECT *, old < 10 OR new * 2 >= old AS accepted FROM (SELECT p_brand, count(*) AS old, count(*) FILTER (p_size % 5 < p_partkey % 5) AS new FROM part GROUP BY 1)"


def duplicate_suffix(spark, sf_dir):
    """Repeated names of a category get a number from the second on."""
    k = F.row_number().over(Window.partitionBy("p_type", "p_name").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("name"))


QUERIES["duplicate_suffix"] = duplicate_suffix
ORACLES["duplicate_suffix"] = "SELECT p_partkey, p_name || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part)"


def latest_per_key(spark, sf_dir):
    """The newest record of each key; ties go to the larger id."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


QUERIES["latest_per_key"] = latest_per_key
ORACLES["latest_per_key"] = "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def cache_eviction(spark, sf_dir):
    """Least recently used records to remove, so that the rest of each type fits into 80 % of its cap (its newest half by size)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.round(F.abs("value") * 100).cast("long").alias("size"), F.to_date("ts").alias("day"))
    cap = e.groupBy("event_type").agg(F.sum("size").alias("cap")).withColumnRenamed("event_type", "type")  # a row for each type
    held = running(e, ["event_type"], ["ts", "event_id"], "size", "day", "held", descending=True)
    return held.join(cap, F.col("event_type").eqNullSafe(F.col("type"))).where("held * 10 > cap * 4").select("event_id", "event_type", "held")


QUERIES["cache_eviction"] = cache_eviction
ORACLES["cache_eviction"] = """
SELECT event_id, event_type, held::BIGINT AS held FROM (SELECT *, sum(size) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held, sum(size) OVER (PARTITION BY event_type) AS cap
  FROM (SELECT event_id, event_type, ts, round(abs(value) * 100)::BIGINT AS size FROM events)) WHERE held * 10 > cap * 4"""
