"""Market queries: offers folded, scored and set side by side; stock changes and what was sold; prices in two currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .common import table
from .hot import lagged, running, trailing, upper_median

QUERIES: dict = {}
ORACLES: dict = {}
#: Seconds between two snapshots beyond which their difference says nothing; hours that changes are kept.
FRESH, KEPT_HOURS = 86_400, 48


def _offers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"), "l_discount", "l_returnflag")


def offer_fold(spark, sf_dir):
    """Lots of an item on one market: least price above 0, stock, offers, whether any is available."""
    return _offers(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.min(F.when(F.col("l_extendedprice") > 0, F.col("l_extendedprice"))).alias("price"), F.sum("q").alias("stock"), F.count("*").alias("lots"), F.bool_or(F.col("l_returnflag") != "R").alias("available"))


QUERIES["offer_fold"] = offer_fold
ORACLES["offer_fold"] = "SELECT l_partkey, l_suppkey, min(l_extendedprice) FILTER (l_extendedprice > 0) AS price, sum(l_quantity)::BIGINT AS stock, count(*) AS lots, bool_or(l_returnflag <> 'R') AS available FROM lineitem GROUP BY 1, 2"


def combined_liquidity(spark, sf_dir):
    """Mean of the markets' scores of an item, half to even; markets where it is not available have none."""
    none = F.lit(None).cast("double")
    f = offer_fold(spark, sf_dir).withColumn("s", S.offer_score(F.col("available"), none, F.col("stock"), none, F.col("lots"), none))
    return f.groupBy("l_partkey").agg(F.bround(F.avg("s"), 0).alias("score"), F.count("s").alias("markets")).withColumn("level", S.level(F.col("score")))


QUERIES["combined_liquidity"] = combined_liquidity
ORACLES["combined_liquidity"] = f"""
WITH f AS ({ORACLES["offer_fold"]}), s AS (SELECT l_partkey, CASE WHEN available THEN round_even(least(100.0, least(100.0, 20 * log2(1 + stock)) + least(40, 5 * lots)), 0) END AS s FROM f),
c AS (SELECT l_partkey, round_even(avg(s), 0) AS score, count(s) AS markets FROM s GROUP BY 1)
SELECT *, CASE WHEN score IS NULL THEN 'none' WHEN score >= 60 THEN 'liquid' WHEN score >= 30 THEN 'medium' ELSE 'illiquid' END AS level FROM c"""


def market_board_pivot(spark, sf_dir):
    """Two markets side by side: price and payout after the fee."""
    o = _offers(spark, sf_dir).withColumn("m", F.col("l_suppkey") % 2)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    a = o.groupBy("l_partkey").agg(*[F.min(F.when(F.col("m") == m, cents)).alias(f"cents_{m}") for m in (0, 1)])
    return a.select("l_partkey", "cents_0", "cents_1", F.round(F.col("cents_0") * 0.95, 2).alias("payout_0"), F.round(F.col("cents_1") * 0.9, 2).alias("payout_1"))


QUERIES["market_board_pivot"] = market_board_pivot
ORACLES["market_board_pivot"] = """
SELECT *, round(cents_0 * 0.95::DOUBLE, 2) AS payout_0, round(cents_1 * 0.9::DOUBLE, 2) AS payout_1 FROM (SELECT l_partkey, min(c) FILTER (m = 0) AS cents_0, min(c) FILTER (m = 1) AS cents_1
  FROM (SELECT l_partkey, l_suppkey % 2 AS m, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem) GROUP BY 1)"""


def on_sale_filter(spark, sf_dir):
    """Items with an available offer on a market of a region."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")
    o = _offers(spark, sf_dir).where("l_returnflag <> 'R'").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(o, F.col("p_partkey") == F.col("l_partkey"), "left_semi")


QUERIES["on_sale_filter"] = on_sale_filter
ORACLES["on_sale_filter"] = "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND l_returnflag <> 'R')"


def liquidity_view_pick(spark, sf_dir):
    """The combined score, or one market's own where it has one."""
    c = combined_liquidity(spark, sf_dir).select("l_partkey", "score")
    own = offer_fold(spark, sf_dir).where("l_suppkey = 1").select(F.col("l_partkey").alias("k"), F.bround(F.least(F.lit(100.0), 20 * F.log2(1 + F.col("stock"))), 0).alias("own"))
    return c.join(own, F.col("l_partkey") == F.col("k"), "left").select("l_partkey", F.coalesce("own", "score").alias("shown"))


QUERIES["liquidity_view_pick"] = liquidity_view_pick
ORACLES["liquidity_view_pick"] = f"SELECT c.l_partkey, coalesce(CASE WHEN o.stock IS NOT NULL THEN round_even(least(100.0, 20 * log2(1 + o.stock)), 0) END, c.score) AS shown FROM ({ORACLES['combined_liquidity']}) c LEFT JOIN ({ORACLES['offer_fold']}) o ON o.l_partkey = c.l_partkey AND o.l_suppkey = 1"


def changes(snapshots: DataFrame, fresh_seconds: int = FRESH) -> DataFrame:
    """Snapshots (key columns user_id, event_type; ts, event_id, stock) with sold and listed since the one before.

    Null where there is none before or it is older than ``fresh_seconds``.
    """
    moved = lagged(snapshots.withColumn("day", F.to_date("ts")), ["user_id", "event_type"], ["ts", "event_id"], ["ts", "stock"], "day")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before_ts").cast("timestamp"))
    delta = F.when(gap <= fresh_seconds * 1_000_000, F.col("stock") - F.col("before_stock"))
    return moved.withColumn("delta", delta).select("event_id", "user_id", "event_type", "ts", "stock", *[F.when(F.col("delta").isNotNull(), F.greatest(k * F.col("delta"), F.lit(0))).alias(name) for name, k in (("sold", -1), ("listed", 1))])


def snapshots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.floor("value").cast("long").alias("stock"))


def stock_delta(spark, sf_dir):
    c = changes(snapshots(spark, sf_dir))
    return c.select("event_id", "stock", "sold", "listed")


_DELTA = """SELECT event_id, user_id, event_type, ts, stock, CASE WHEN gap <= 86400000000 THEN greatest(-d, 0) END AS sold, CASE WHEN gap <= 86400000000 THEN greatest(d, 0) END AS listed FROM (
  SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, stock - lag(stock) OVER w AS d FROM (SELECT event_id, user_id, event_type, ts, floor(value)::BIGINT AS stock FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""
QUERIES["stock_delta"] = stock_delta
ORACLES["stock_delta"] = f"SELECT event_id, stock, sold, listed FROM ({_DELTA})"


def _kept_changes(spark, sf_dir) -> DataFrame:
    c = changes(snapshots(spark, sf_dir)).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return trailing(c, ["user_id", "event_type"], "t", KEPT_HOURS * 3600 * 1_000_000, {"sold_48h": F.col("sold"), "listed_48h": F.col("listed")})


def sold_listed_48h(spark, sf_dir):
    """What was sold and listed in the 48 hours up to each snapshot, bounds included."""
    return _kept_changes(spark, sf_dir).select("event_id", "sold_48h", "listed_48h")


QUERIES["sold_listed_48h"] = sold_listed_48h
ORACLES["sold_listed_48h"] = f"SELECT event_id, (sum(sold) OVER w)::BIGINT AS sold_48h, (sum(listed) OVER w)::BIGINT AS listed_48h FROM ({_DELTA}) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND CURRENT ROW)"


def sold_48h_latest(spark, sf_dir):
    """The figures at each item's last snapshot; null where it has no stock."""
    last = _kept_changes(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by(F.struct("stock", "sold_48h"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", F.col("x.stock").alias("stock"), F.when(F.col("x.stock") > 0, F.col("x.sold_48h")).alias("sold_48h"))


QUERIES["sold_48h_latest"] = sold_48h_latest
ORACLES["sold_48h_latest"] = f"""
SELECT user_id, event_type, stock, CASE WHEN stock > 0 THEN s END AS sold_48h FROM (SELECT *, (sum(sold) OVER w)::BIGINT AS s FROM ({_DELTA}) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND CURRENT ROW))
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def site_ratio(spark, sf_dir):
    """Upper median of the ratio of two prices of each market, where the first is at least 1."""
    r = _offers(spark, sf_dir).where("q >= 1").select("l_suppkey", (F.col("l_extendedprice") / F.col("q")).alias("r"))
    return upper_median(r, ["l_suppkey"], "r", "ratio")


QUERIES["site_ratio"] = site_ratio
ORACLES["site_ratio"] = "SELECT l_suppkey, r AS ratio FROM (SELECT l_suppkey, l_extendedprice / l_quantity AS r FROM lineitem WHERE l_quantity >= 1) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY r) = count(*) OVER (PARTITION BY l_suppkey) // 2 + 1"


def money_dual(spark, sf_dir):
    """Both currencies of each item, exact or converted at 80, after a fee of 5 %."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    usd, rub = F.when(k != 1, F.col("p_retailprice")), F.when(k != 0, F.col("p_retailprice") * 80)
    got = S.money(usd, rub, k == 2, k == 1, F.lit(80.0), F.lit(0.95))
    return p.select("p_partkey", F.round(got["usd"], 4).alias("usd"), got["usd_approx"].alias("usd_approx"), F.round(got["rub"], 4).alias("rub"), got["rub_approx"].alias("rub_approx"))


QUERIES["money_dual"] = money_dual
ORACLES["money_dual"] = """
SELECT p_partkey, round(CASE WHEN k IN (1, 2) THEN p_retailprice * 80 / 80.0::DOUBLE ELSE p_retailprice END * 0.95::DOUBLE, 4) AS usd, k IN (1, 2) AS usd_approx,
  round(p_retailprice * 80.0::DOUBLE * 0.95::DOUBLE, 4) AS rub, k NOT IN (1, 2) AS rub_approx FROM (SELECT *, p_partkey % 4 AS k FROM part)"""


def _days(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", *columns, F.to_date("ts").alias("day"))


def price_pair_check(spark, sf_dir):
    """An older price survives beside a newer one if it is within 2 % of what the ratio leads to expect."""
    e = lagged(_days(spark, sf_dir, "value"), ["user_id"], ["ts", "event_id"], ["value"], "day")
    sure = F.abs(F.col("before_value") - F.col("value")) <= 0.02 * F.abs(F.col("value"))
    return e.select("event_id", F.when(sure, F.col("before_value")).alias("kept"), F.coalesce(sure, F.lit(False)).alias("sure"))


QUERIES["price_pair_check"] = price_pair_check
ORACLES["price_pair_check"] = """
SELECT event_id, CASE WHEN abs(b - value) <= 0.02::DOUBLE * abs(value) THEN b END AS kept, coalesce(abs(b - value) <= 0.02::DOUBLE * abs(value), false) AS sure
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"""


def appraisal_totals(spark, sf_dir):
    """Totals of each order in cents; a total is missing if a line has no price, and says what only the other has."""
    li = table(spark, sf_dir, "lineitem")
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    usd, rub = F.when(F.col("l_linenumber") != 3, c), F.when(F.col("l_linenumber") != 5, c * 80)
    t = li.groupBy("l_orderkey").agg(F.sum(usd).alias("u"), F.sum(rub).alias("r"), F.count_if(usd.isNull()).alias("no_usd"), F.count_if(rub.isNull()).alias("no_rub"), F.sum(F.when(usd.isNull(), rub)).alias("only_rub"))
    return t.select("l_orderkey", F.when(F.col("no_usd") == 0, F.col("u")).alias("usd_cents"), F.when(F.col("no_rub") == 0, F.col("r")).alias("rub_cents"), F.when((F.col("no_usd") > 0) & (F.col("no_rub") > 0), F.col("only_rub")).alias("only_rub_cents"))


QUERIES["appraisal_totals"] = appraisal_totals
ORACLES["appraisal_totals"] = """
SELECT l_orderkey, CASE WHEN count(*) FILTER (u IS NULL) = 0 THEN sum(u) END::BIGINT AS usd_cents, CASE WHEN count(*) FILTER (r IS NULL) = 0 THEN sum(r) END::BIGINT AS rub_cents,
  CASE WHEN count(*) FILTER (u IS NULL) > 0 AND count(*) FILTER (r IS NULL) > 0 THEN sum(r) FILTER (u IS NULL) END::BIGINT AS only_rub_cents
FROM (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN c END AS u, CASE WHEN l_linenumber <> 5 THEN c * 80 END AS r FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem)) GROUP BY 1"""


def best_market(spark, sf_dir):
    """The market with the larger payout of each item and by how much; null if a side is unknown."""
    b = market_board_pivot(spark, sf_dir)
    return b.select("l_partkey", F.when(F.col("payout_0") >= F.col("payout_1"), 0).when(F.col("payout_1") > F.col("payout_0"), 1).alias("best"), F.round(F.abs(F.col("payout_0") - F.col("payout_1")), 2).alias("by"))


QUERIES["best_market"] = best_market
ORACLES["best_market"] = f"SELECT l_partkey, CASE WHEN payout_0 >= payout_1 THEN 0 WHEN payout_1 > payout_0 THEN 1 END AS best, round(abs(payout_0 - payout_1), 2) AS by FROM ({ORACLES['market_board_pivot']})"


def rate_from_json(spark, sf_dir):
    """A number out of nested JSON for each type: the last that is not null."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.max_by("k", F.when(F.col("k").isNotNull(), F.struct("ts", "event_id"))).alias("rate"), F.count("k").alias("seen"))


QUERIES["rate_from_json"] = rate_from_json
ORACLES["rate_from_json"] = "SELECT event_type, max_by(k, (ts, event_id)) AS rate, count(k) AS seen FROM (SELECT *, try_cast(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1"


def pace_gaps(spark, sf_dir):
    """Visits of each user: events less than six hours apart; per visit the first, the number and the longest gap in seconds."""
    e = lagged(_days(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["ts"], "day")
    e = e.withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before_ts").cast("timestamp")))
    e = running(e.withColumn("starts", F.when(F.col("gap") < 21_600_000_000, 0).otherwise(1)), ["user_id"], ["ts", "event_id"], "starts", "day", "visit")
    return e.groupBy("user_id", "visit").agg(F.min("ts").alias("first"), F.count("*").alias("events"), (F.max(F.when(F.col("gap") < 21_600_000_000, F.col("gap"))) / 1_000_000).cast("long").alias("longest"))


QUERIES["pace_gaps"] = pace_gaps
ORACLES["pace_gaps"] = """
SELECT user_id, visit::BIGINT AS visit, min(ts) AS first, count(*) AS events, (max(gap) FILTER (gap < 21600000000) // 1000000)::BIGINT AS longest FROM (
  SELECT *, sum(CASE WHEN gap < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit
  FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY 1, 2"""
