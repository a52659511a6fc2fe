"""What changes over polls: partial snapshots, errors, life cycles of products, refresh decisions, rates and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import parse_verdict, refresh_reason
from .both import check_text, register, spark_text
from .common import table
from .hot import lagged, running

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, doc: str, text: str) -> None:
    register(QUERIES, ORACLES, name, doc, text)


_OLD = "(SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS v, max(o_orderdate) AS at_ FROM $orders$ WHERE o_orderstatus = 'F' GROUP BY o_custkey)"
_NEW = "(SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS v, max(o_orderdate) AS at_ FROM $orders$ WHERE o_orderstatus = 'O' GROUP BY o_custkey)"
_add("snapshot_merge", "A complete snapshot replaces the old one, a partial one goes over it: rows of either, the new ones first. Markets with an even key are complete.", f"""
SELECT k, v, fresh FROM (SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, n.k IS NOT NULL AS fresh FROM {_OLD} o FULL OUTER JOIN {_NEW} n ON o.k = n.k) m WHERE fresh OR k % 2 = 1""")
_add("cards_newest", "Visible rows and product cards, the newer of each key; cards without a link get #2, #3 behind their name.", """
SELECT name, source, CASE WHEN n = 1 THEN name ELSE concat(name, ' #', CAST(n AS STRING)) END AS label FROM (SELECT name, source, row_number() OVER (PARTITION BY name ORDER BY k) AS n
  FROM (SELECT k, max_by(name, at_ * 10 + source) AS name, max_by(source, at_ * 10 + source) AS source FROM (SELECT p_partkey AS k, p_name AS name, 1 AS source, p_size AS at_ FROM $part$ WHERE p_partkey % 3 < 2 UNION ALL SELECT p_partkey AS k, p_name AS name, 2 AS source, 50 - p_size AS at_ FROM $part$ WHERE p_partkey % 3 > 0) u GROUP BY k) w) x""")
_add("errors_carried", "Errors after a load: those of categories done again go, new failures come.", """
WITH done AS (SELECT DISTINCT p_type AS c FROM $part$ WHERE p_size = 7), old AS (SELECT p_type AS c, min(p_partkey) AS e FROM $part$ WHERE p_size % 2 = 0 GROUP BY p_type), new_ AS (SELECT p_type AS c, -max(p_partkey) AS e FROM $part$ WHERE p_brand = 'Brand#13' GROUP BY p_type)
SELECT o.c, o.e FROM old o LEFT JOIN done d ON o.c = d.c LEFT JOIN new_ n ON o.c = n.c WHERE d.c IS NULL AND n.c IS NULL UNION ALL SELECT c, e FROM new_""")
_add("touched_categories", "Categories whose rows changed while a load ran: not to be overwritten by it.", """
SELECT DISTINCT c FROM (SELECT p_brand AS c, count(*) AS n, sum(p_size) AS s FROM $part$ GROUP BY p_brand EXCEPT SELECT p_brand AS c, count(*) AS n, sum(CASE WHEN p_partkey % 397 = 0 THEN p_size + 1 ELSE p_size END) AS s FROM $part$ GROUP BY p_brand) q""")
_add("known_keys", "Keys of a request that the catalogue knows.", """
SELECT DISTINCT l_partkey % 3000 AS k FROM $lineitem$ WHERE l_partkey % 3000 IN (SELECT p_partkey FROM $part$ WHERE p_size > 3)""")
_add("counts_reconciled", "Text rows and picture tiles of a screenshot: of each item the larger count, never both.", """
SELECT coalesce(t.shot, p.shot) AS shot, coalesce(t.item, p.item) AS item, greatest(coalesce(t.n, 0), coalesce(p.n, 0)) AS n FROM (SELECT o_custkey AS shot, o_orderpriority AS item, count(*) AS n FROM $orders$ WHERE o_orderstatus = 'F' GROUP BY 1, 2) t
FULL OUTER JOIN (SELECT o_custkey AS shot, o_orderpriority AS item, count(*) AS n FROM $orders$ WHERE o_orderstatus <> 'F' GROUP BY 1, 2) p ON t.shot = p.shot AND t.item = p.item""")
_add("features_current", "A stored feature counts while its picture's address is the same.", """
SELECT s.k, s.v FROM (SELECT p_partkey AS k, p_brand AS url, p_size AS v FROM $part$) s JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_brand END AS url FROM $part$) n ON s.k = n.k AND s.url = n.url""")
_RUNS = "(SELECT user_id, ts, event_id, event_type = 'error' AS miss, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM $events$)"
_add("gone_products", "Products whose page is missing: gone after three misses in a row, twelve hours or more after the first; kept as gone for three days after the last.", f"""
SELECT user_id, misses, gone, gone AND last_miss >= (SELECT max(ts) FROM $events$) - INTERVAL 72 HOUR AS remembered FROM (SELECT user_id, run, count(*) AS misses, max(ts) AS last_miss, count(*) >= 3 AND max(ts) >= min(ts) + INTERVAL 12 HOUR AS gone, row_number() OVER (PARTITION BY user_id ORDER BY run DESC) AS k
  FROM {_RUNS} r WHERE miss GROUP BY user_id, run) q WHERE k = 1""")
#: Fixed values, in seconds: a pause between polls beyond this is downtime; idle time after which a product is hidden, and forgotten.
ALLOWED, HIDDEN_AFTER, FORGOTTEN_AFTER = 1_800, 21_600, 604_800


def staleness(polls: DataFrame, seen: DataFrame, allowed: int = ALLOWED) -> DataFrame:
    """(market, product, idle, state) of products (market, product, at: whole seconds, each that of a poll) at the last of their market's polls (market, at).

    Time in which nothing was polled is nobody's fault: of a pause between two polls what is beyond ``allowed`` seconds
    doesn't count as idle. Polls of a market are cut into days, so that one with many is not one task. A null market is
    a market, null times are left out.
    """
    times = polls.where("at is not null").select("market", "at").distinct().withColumn("day", F.floor(F.col("at") / 86_400))
    gaps = lagged(times, ["market"], ["at"], ["at"], "day").withColumn("down", F.coalesce(F.greatest(F.col("at") - F.col("before_at") - allowed, F.lit(0)), F.lit(0)))
    spent = running(gaps.select("market", "at", "day", "down"), ["market"], ["at"], "down", "day", "lost")
    now = spent.groupBy(F.col("market").alias("_m")).agg(F.max("at").alias("now"), F.max("lost").alias("all_lost"))
    last = seen.where("at is not null").groupBy("market", "product").agg(F.max("at").alias("at"))
    then = spent.select(F.col("market").alias("_s"), F.col("at").alias("_at"), "lost")
    told = last.join(then, F.col("market").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_at"))).join(now, F.col("market").eqNullSafe(F.col("_m")))
    idle = F.col("now") - F.col("at") - (F.col("all_lost") - F.col("lost"))
    return told.select("market", "product", idle.alias("idle"), F.when(idle > FORGOTTEN_AFTER, "forgotten").when(idle > HIDDEN_AFTER, "hidden").otherwise("shown").alias("state"))


def stale_products(spark, sf_dir: str) -> DataFrame:
    """Products of each kind of event by the time since they were last seen, less pauses of that kind's polls beyond thirty minutes: hidden after six hours, forgotten after seven days."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("market"), F.col("user_id").alias("product"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return staleness(events, events)


QUERIES["stale_products"] = stale_products
ORACLES["stale_products"] = """
WITH e AS (SELECT event_type AS market, user_id AS product, floor(epoch(ts))::BIGINT AS t FROM events), p AS (SELECT DISTINCT market, t FROM e),
g AS (SELECT market, t, greatest(0, coalesce(t - lag(t) OVER (PARTITION BY market ORDER BY t) - 1800, 0)) AS down FROM p), c AS (SELECT market, t, sum(down) OVER (PARTITION BY market ORDER BY t) AS lost FROM g),
l AS (SELECT market, product, max(t) AS t FROM e GROUP BY ALL), i AS (SELECT l.market, product, (SELECT max(t) FROM c WHERE c.market = l.market) - l.t - (SELECT max(lost) FROM c WHERE c.market = l.market) + c.lost AS idle FROM l JOIN c ON c.market = l.market AND c.t = l.t)
SELECT market, product, idle::BIGINT AS idle, CASE WHEN idle > 7 * 86400 THEN 'forgotten' WHEN idle > 6 * 3600 THEN 'hidden' ELSE 'shown' END AS state FROM i"""
_CATALOGUES = "(SELECT p_partkey, p_partkey % 11 = 0 AS paused, p_size % 9 AS items, CASE WHEN p_partkey % 7 > 0 THEN p_size * (100 + 900 * (p_partkey % 2)) END AS age, p_partkey % 3 AS errors, CASE WHEN p_partkey % 5 > 0 THEN p_size % 4 END AS site_date, p_partkey % 4 AS own_date FROM $part$)"


def refresh_decisions(spark, sf_dir: str) -> DataFrame:
    """Why a catalogue is loaded again: paused, empty, too old, errors that are a quarter of an hour old, or another date on the site; the first reason that holds."""
    rows = spark.sql(spark_text(f"SELECT * FROM {_CATALOGUES} q"), part=table(spark, sf_dir, "part"))
    return rows.select("p_partkey", refresh_reason(*map(F.col, ("paused", "items", "age", "errors", "site_date", "own_date"))).alias("reason"))


QUERIES["refresh_decisions"] = refresh_decisions
ORACLES["refresh_decisions"] = check_text(f"""
SELECT p_partkey, CASE WHEN paused THEN 'paused' WHEN items = 0 THEN 'empty' WHEN age > 12 * 3600 OR age IS NULL THEN 'old' WHEN age >= 15 * 60 AND errors > 0 THEN 'errors' WHEN site_date IS NULL THEN 'no date' WHEN site_date = own_date THEN 'same' ELSE 'changed' END AS reason FROM {_CATALOGUES} q""")
_add("rates_kept", "The rate at each poll: a failed one keeps the last good value; when it is read again, after ten minutes or, after a failure, one.", """
SELECT event_id, max(good) OVER (PARTITION BY user_id, run) AS rate, CASE WHEN good IS NULL THEN 60 ELSE 600 END AS again
FROM (SELECT user_id, event_id, good, count(good) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS good FROM $events$) e) r""")
_add("cycle_expiry", "Rows of a rotating scan: at the end of a cycle only those seen in it stay, and after a pause of three hours the scan fills up again.", """
SELECT e.user_id, c.cycle, c.gap > 10800 AS refill, max(e.value) AS price FROM $events$ e JOIN (SELECT user_id, max(CAST(floor(event_id / 500) AS BIGINT)) AS cycle, max(gap) AS gap FROM (SELECT user_id, event_id, CAST(floor(unix_(ts)) AS BIGINT) - lag(CAST(floor(unix_(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM $events$) g GROUP BY user_id) c
ON e.user_id = c.user_id AND CAST(floor(e.event_id / 500) AS BIGINT) = c.cycle GROUP BY e.user_id, c.cycle, c.gap""")
_add("links_applied", "Links of users: the last one of an item counts, an empty one takes it away; applied at once where the product is shown.", """
SELECT l.item, l.product, o.product IS NOT NULL AS shown FROM (SELECT user_id AS item, max_by(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END, event_id) AS product, max_by(event_type, event_id) AS what FROM $events$ GROUP BY user_id) l
LEFT JOIN (SELECT DISTINCT p_partkey AS product FROM $part$ WHERE p_size > 20) o ON o.product = l.product WHERE l.what <> 'error'""")
_add("stale_names", "Whether a snapshot has rows with names of an old form, and so has to be loaded again.", """
SELECT p_brand, bool_or(LIKES(CASE WHEN p_partkey % 400 = 0 THEN 'C. Old' ELSE p_name END, '^C[.] ')) AS refresh FROM $part$ GROUP BY p_brand""")
_add("sales_known", "For how many products of a shop the sales are known.", """
SELECT l_suppkey AS shop, count(CASE WHEN l_discount > 0 THEN 1 END) AS known, count(*) AS products FROM $lineitem$ GROUP BY l_suppkey""")
_add("true_secret_filter", "Items that are neither secret (a value of a million or more) nor placeholders (neither demand nor rarity), and the number hidden.", """
SELECT p_type, CAST(count_if(NOT secret AND NOT placeholder) AS BIGINT) AS shown, CAST(count_if(secret) AS BIGINT) AS hidden FROM (SELECT p_type, coalesce(p_retailprice * 800 >= 1000000, false) AS secret, (CASE WHEN p_size % 4 > 0 THEN p_size END) IS NULL AND (CASE WHEN p_partkey % 3 > 0 THEN p_size END) IS NULL AS placeholder FROM $part$) q GROUP BY p_type""")
_PARSED = "(SELECT p_name AS c, count(*) AS old, count_if(p_size % 3 = 0 AND p_partkey % 2 = 0 OR length(p_name) % 3 = 0) AS new_, CAST(floor(count_if(p_partkey % 4 = 0) / (1 + min(p_partkey) % 5)) AS BIGINT) AS orphans, min(p_partkey) % 7 = 0 AS imported, max(p_partkey) % 9 = 0 AS repeated FROM $part$ GROUP BY p_name)"


def trust_check_full(spark, sf_dir: str) -> DataFrame:
    """Whether a parse is trusted: refused when empty, when it has more orphans than two and a tenth of its items, or when a category of ten or more shrank below half, unless it was an import or repeats."""
    rows = spark.sql(spark_text(f"SELECT * FROM {_PARSED} q"), part=table(spark, sf_dir, "part"))
    return rows.select("c", parse_verdict(*map(F.col, ("new_", "orphans", "old", "imported", "repeated"))).alias("verdict"))


QUERIES["trust_check_full"] = trust_check_full
ORACLES["trust_check_full"] = check_text(f"""
SELECT c, CASE WHEN new_ = 0 THEN 'empty' WHEN orphans > 2 AND orphans * 10 > new_ THEN 'orphans' WHEN old < 10 OR new_ * 2 >= old OR imported OR repeated THEN 'taken' ELSE 'shrank' END AS verdict FROM {_PARSED} q""")
