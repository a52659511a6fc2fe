"""Offers of shops: their rows decoded, price pairs and the work that a poll has to do; how offers fit items is in ``fit.py``.

Prices and stock come from sizes and keys of parts.
"""

from __future__ import annotations

from .both import register

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, doc: str, text: str) -> None:
    register(QUERIES, ORACLES, name, doc, text)


_add("picked_items", "Items that a user picked, with quantities from 1 to 9999, 500 at most.", """
SELECT p_partkey, p_name, qty FROM (SELECT p.p_partkey, p.p_name, least(greatest(k.qty, 1), 9999) AS qty, row_number() OVER (ORDER BY k.line, p.p_partkey) AS n
  FROM $part$ p JOIN (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS line, CAST(sum(floor(l_quantity)) * 100 - 9000 AS BIGINT) AS qty FROM $lineitem$ WHERE l_returnflag = 'R' GROUP BY l_partkey) k ON k.l_partkey = p.p_partkey) q WHERE n <= 500""")

# two snapshots of prices, in dollars and in roubles, that aren't of one age
_SNAP = lambda status: f"(SELECT o_custkey AS product, max_by(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS k, CASE WHEN count(*) > 1 AND max_by(o_totalprice, o_orderkey) > 5e4 THEN max_by(o_totalprice, o_orderkey) ELSE min(o_totalprice) END AS before FROM $orders$ WHERE o_orderstatus = '{status}' GROUP BY o_custkey)"
_PRICES = f"""(SELECT coalesce(u.product, r.product) AS product, CASE WHEN u.price > 3e4 THEN u.price END AS fresh, u.product IS NOT NULL AS seen, CASE WHEN r.price > 3e4 THEN CASE WHEN r.product % 2 = 0 THEN u.price * (9e1 + r.product % 8) ELSE r.price * 9e1 END END AS older,
  u.price = u.before AS fresh_same, r.price = r.before AS older_same, CASE WHEN coalesce(u.product, r.product) % 5 = 0 THEN 9.2e1 END AS own FROM {_SNAP('F')} u FULL OUTER JOIN {_SNAP('O')} r ON u.product = r.product)"""
_VERIFIED = "CASE WHEN NOT seen OR fresh IS NULL OR older IS NULL THEN false WHEN sure THEN true ELSE abs(older - fresh * coalesce(own, 9.5e1)) <= 2e-2 * fresh * coalesce(own, 9.5e1) END"
_TOLD = f"(SELECT *, {_VERIFIED} AS verified FROM (SELECT *, coalesce(fresh_same, false) AND coalesce(older_same, false) AS sure FROM {_PRICES} p) q)"
_PAIRED = f"(SELECT product, own, sure, verified, CASE WHEN seen THEN fresh IS NOT NULL ELSE older IS NOT NULL END AS available, fresh AS usd, CASE WHEN NOT seen OR (fresh IS NOT NULL AND verified) THEN older END AS rub FROM {_TOLD} t)"
_add("price_pairs_full", "Prices of two currencies from snapshots of different age: the newer says what is on sale, the older price stays only if the pair is right.",
     f"SELECT product, available, round(usd, 2) AS usd, round(coalesce(rub, usd * coalesce(own, 9.5e1)), 2) AS rub, rub IS NULL AND usd IS NOT NULL AS approx FROM {_PAIRED} p")
_add("own_ratio_fold", "A product's own ratio of its two prices: a sure pair replaces it, a verified one sets it where there is none.",
     f"SELECT product, round(CASE WHEN usd > 0 AND rub > 0 AND (sure OR (verified AND own IS NULL)) THEN rub / usd ELSE own END, 6) AS ratio FROM {_PAIRED} p WHERE own IS NOT NULL OR (usd > 0 AND rub > 0 AND (sure OR verified))")

_add("sweep_popularity", "A sweep's products once each, at the place where they are first seen; popularity is the place over the number.", """
SELECT p_type, p_name, place, round((place - 1) / (n * 1e0), 9) AS popularity FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY first_key) AS place, greatest(count(*) OVER (PARTITION BY p_type), 1) AS n
  FROM (SELECT p_type, p_name, min(p_partkey) AS first_key FROM $part$ GROUP BY p_type, p_name) f) g""")
_add("enrichment_queue", "The four products of each shop to read next: never read first, then the oldest, then the dearest.", """
SELECT shop, product, place FROM (SELECT l_suppkey AS shop, l_partkey AS product, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN at_ IS NULL THEN 0 ELSE 1 END, at_, price DESC, l_partkey) AS place
  FROM (SELECT l_suppkey, l_partkey, max(CASE WHEN l_partkey % 3 > 0 THEN l_shipdate END) AS at_, max(l_extendedprice) AS price FROM $lineitem$ GROUP BY l_suppkey, l_partkey) r) q WHERE place <= 4""")
_add("order_book", "The cheapest lot of a product, and the number of lots where the book is not cut off at 72.", """
SELECT l_partkey AS product, min(l_extendedprice) AS cheapest, CASE WHEN count(*) < 72 THEN count(*) END AS lots FROM $lineitem$ WHERE l_returnflag <> 'R' AND l_quantity > 0 GROUP BY l_partkey""")
_add("shop_variants", "Shop products by their variants: least price, sum of the stocks that are not negative, whether one is available.", """
SELECT l_orderkey AS product, round(min(l_extendedprice), 2) AS price, CAST(sum(CASE WHEN l_quantity - 10 >= 0 THEN floor(l_quantity - 10) ELSE 0 END) AS BIGINT) AS stock, bool_or(l_returnflag <> 'R') AS available FROM $lineitem$ GROUP BY l_orderkey""")
_add("shop_minor_units", "Prices in minor units, by the currency's number of digits.", """
SELECT p_partkey, round(p_size * 1000 / pow(10e0, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END), 4) AS price FROM $part$""")
_add("offer_rows_decoded", "Raw offers to rows: those without a name or of an unusual kind, and baits below a cent, go; chroma names say so; a quantity is one at least.", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 AND NOT lower(name_) LIKE 'chroma%' THEN concat('Chroma ', name_) ELSE name_ END AS name, kind, price, CASE WHEN q > 0 THEN q ELSE 1 END AS quantity
FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE trim(p_name) END AS name_, lower(CASE p_size % 4 WHEN 0 THEN 'Gun' WHEN 1 THEN 'Knife' WHEN 2 THEN 'Other' ELSE 'Pet' END) AS kind, CASE WHEN p_partkey % 17 = 0 THEN 1e-5 ELSE p_retailprice END AS price, p_size - 5 AS q FROM $part$) r
WHERE name_ <> '' AND kind <> 'other' AND price >= 1e-2""")
_add("source_precedence", "Of the sources of a shop's products the first that has any.", """
SELECT shop, source, product FROM (SELECT shop, source, product, dense_rank() OVER (PARTITION BY shop ORDER BY source) AS k FROM (SELECT l_suppkey AS shop, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS source, l_partkey AS product FROM $lineitem$ WHERE l_suppkey % 3 = 0 OR l_returnflag <> 'A' GROUP BY 1, 2, 3) p) q WHERE k = 1""")
_add("product_offers", "Cached products as offers: unread ones and those not seen for six hours go; a missing page is not for sale, with an unknown number of lots.", """
SELECT id, CASE WHEN missing THEN NULL ELSE price END AS price, CASE WHEN missing THEN NULL ELSE lots END AS stock, CASE WHEN missing THEN false WHEN lots IS NOT NULL THEN lots > 0 ELSE price IS NOT NULL END AS available
FROM (SELECT event_id AS id, CASE WHEN event_id % 4 > 0 THEN value END AS price, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS lots, event_type = 'error' AS missing, ts >= (SELECT max(ts) FROM $events$) - INTERVAL 6 HOUR AS recent FROM $events$) e
WHERE recent AND NOT (price IS NULL AND lots IS NULL AND NOT missing)""")
_add("market_tab_sorted", "The market tab: rows with an offer on sale, by the number of lots, nulls last, then by name; 600 at most.", """
SELECT p_partkey, name_, lots, place FROM (SELECT p_partkey, p_name AS name_, lots, row_number() OVER (ORDER BY CASE WHEN lots IS NULL THEN 1 ELSE 0 END, lots DESC, p_name, p_partkey) AS place
  FROM (SELECT p.p_partkey, p.p_name, CASE WHEN p.p_size % 6 > 0 THEN o.lots END AS lots FROM $part$ p JOIN (SELECT l_partkey, count(*) AS lots FROM $lineitem$ WHERE l_returnflag <> 'R' GROUP BY l_partkey) o ON o.l_partkey = p.p_partkey) q) r WHERE place <= 600""")
_add("best_market_difference", "The better of two markets and by how much; unknown when the smaller side has unpriced lots, at least so much when the larger has; a tie goes to the second.", """
SELECT p_partkey, CASE WHEN a > b THEN 'first' ELSE 'second' END AS better, CASE WHEN CASE WHEN a > b THEN ub ELSE ua END > 0 THEN NULL ELSE round(abs(a - b), 2) END AS difference, CASE WHEN a > b THEN ua ELSE ub END > 0 AND CASE WHEN a > b THEN ub ELSE ua END = 0 AS at_least
FROM (SELECT l_partkey AS p_partkey, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS a, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS b,
  count_if(l_linestatus = 'F' AND l_discount = 0) AS ua, count_if(l_linestatus = 'O' AND l_discount = 0) AS ub FROM $lineitem$ GROUP BY l_partkey) q""")
_add("image_sources", "Where an item's picture comes from: the market's, else the site's; sets have none.", """
SELECT p_partkey, coalesce(m.image, CASE WHEN p_size % 2 = 0 THEN concat('site/', CAST(p_partkey AS STRING)) END) AS image FROM $part$ p LEFT JOIN (SELECT l_partkey, concat('market/', CAST(min(l_suppkey) AS STRING)) AS image FROM $lineitem$ WHERE l_returnflag = 'A' GROUP BY l_partkey) m ON m.l_partkey = p.p_partkey WHERE p_type <> 'ECONOMY'""")
