"""Pages and texts as lines: HTML to visible lines, labels and fields of cards, JSON in pages, and names found in lines."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .both import forms, register
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, doc: str, text: str) -> None:
    register(QUERIES, ORACLES, name, doc, text)


#: Elements that are never shown, and those that begin a line.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
BLOCKS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
_DROP = "(?is)<!--.*?-->|" + "|".join(f"<{x}[^>]*>.*?</{x} *>" for x in HIDDEN)
_BREAK = f"(?i)</?({'|'.join(BLOCKS)})([ /][^>]*)?>"


def visible_lines(html: Column) -> Column:
    """Lines that a reader of the page sees, in order, without empty ones; white space within a line is one space."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), _DROP, " ")
    x = F.regexp_replace(F.regexp_replace(x, r"[\x09-\x0D]+", " "), _BREAK, "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, " +", " "))), lambda s: s != "")


def html_lines(spark, sf_dir: str) -> DataFrame:
    """Every visible line of every page with its place."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(visible_lines(F.col("html"))).alias("line", "text"))


QUERIES["html_lines"] = html_lines
ORACLES["html_lines"] = f"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '{_DROP}', ' ', 'g') AS x FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(x, '[\\x09-\\x0D]+', ' ', 'g'), '{_BREAK}', chr(10), 'g') AS x FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(regexp_replace(s, ' +', ' ', 'g'))), lambda s: s <> '') AS l FROM c)
SELECT page_id, (i - 1)::INT AS line, l[i] AS text FROM d, unnest(range(1, len(l) + 1)) AS r(i)"""

_add("meta_tags", "Values of meta tags by name or property, and the language of the page.", """
SELECT page_id, FOUND(h, '(?i)<meta[^>]*(?:name|property)="description"[^>]*content="([^"]*)"', 1) AS description, FOUND(h, '(?i)<meta[^>]*charset="?([^">]+)', 1) AS charset, lower(FOUND(h, '(?i)<html[^>]*lang="([^"]*)"', 1)) AS lang, FOUND(h, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical
FROM (SELECT page_id, coalesce(html, '') AS h FROM $pages$) p""")

_LABELLED = forms("p_partkey", "Value - #  Demand - 7 Rarity: 3", "Ice Wing", "Demand: 5", "Value: [10 - #] Stability - Stable", "Rarity - 2 of 9", "Seer Value: N/A")
_END = "(?: *(?:Value|Demand|Rarity|Stability) *[:-]|$)"
_add("label_segments", "A line cut at its labels: the text before them and the value of each.", f"""
SELECT p_partkey, CASE WHEN LIKES(t, '^ *(Value|Demand|Rarity|Stability) *[:-]') THEN NULL ELSE trim(FOUND(t, '^(.*?){_END}', 1)) END AS head, FOUND(t, 'Value *[:-] *(.*?){_END}', 1) AS value, FOUND(t, 'Demand *[:-] *(.*?){_END}', 1) AS demand, FOUND(t, 'Rarity *[:-] *(.*?){_END}', 1) AS rarity, FOUND(t, 'Stability *[:-] *(.*?){_END}', 1) AS stability
FROM (SELECT p_partkey, {_LABELLED} AS t FROM $part$) q""")

_CARDS = forms("event_id", "Ice Wing", "Value - #", "Demand - 7", "Seer", "Demand - 3", "Value - 9", "Value - 12", "Candy", "Rarity - 4", "footer text", "Elder", "Value - 1")
_add("cards_from_lines", "Cards of a page: a line that is no label, before a label, is a name; the labels after it are its fields, the first of each counts, labels before any name are orphans.", f"""
WITH l AS (SELECT user_id AS page, event_id AS pos, t, FOUND(t, '^(Value|Demand|Rarity) - ', 1) AS label, FOUND(t, ' - (.*)$', 1) AS v FROM (SELECT user_id, event_id, {_CARDS} AS t FROM $events$) q),
n AS (SELECT *, CASE WHEN label IS NULL AND lead(label) OVER (PARTITION BY page ORDER BY pos) IS NOT NULL THEN 1 ELSE 0 END AS name_ FROM l),
c AS (SELECT *, CAST(sum(name_) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS card FROM n)
SELECT page, card, max(CASE WHEN name_ = 1 THEN t END) AS name, min_by(v, CASE WHEN label = 'Value' THEN pos END) AS value, min_by(v, CASE WHEN label = 'Demand' THEN pos END) AS demand, min_by(v, CASE WHEN label = 'Rarity' THEN pos END) AS rarity, CASE WHEN card = 0 THEN count(label) ELSE 0 END AS orphans
FROM c GROUP BY page, card HAVING card > 0 OR count(label) > 0""")
_add("cards_enriched", "Fields of the popup fill what a card lacks; names that only the popup has become cards where a page has none.", """
SELECT coalesce(c.name, p.name) AS name, coalesce(c.value, p.value) AS value, coalesce(c.demand, p.demand) AS demand, c.name IS NULL AS popup_only
FROM (SELECT p_name AS name, max(CASE WHEN p_size % 2 = 0 THEN p_size END) AS value, max(CASE WHEN p_size % 3 = 0 THEN p_size END) AS demand FROM $part$ WHERE p_brand < 'Brand#2' GROUP BY p_name) c
FULL OUTER JOIN (SELECT p_name AS name, min(p_size) AS value, min(p_partkey) AS demand FROM $part$ WHERE p_brand >= 'Brand#2' GROUP BY p_name) p ON c.name = p.name""")
_add("site_dates", "The date behind an update label: on its line, else the next line that is more than dashes; a time on a line of its own is joined.", f"""
SELECT page, pos, CASE WHEN LIKES(d, '[0-9]') THEN CASE WHEN NOT contains(d, ':') AND LIKES(lower(nxt), '^at +[0-9]') THEN concat(d, ' ', nxt) ELSE d END END AS found
FROM (SELECT page, pos, CASE WHEN LIKES(own, '[0-9]') THEN own WHEN dash1 THEN n2 ELSE n1 END AS d, CASE WHEN LIKES(own, '[0-9]') THEN n1 WHEN dash1 THEN n3 ELSE n2 END AS nxt
  FROM (SELECT page, pos, t, trim(SUBST(t, '^Values Last Updated *-? *', '')) AS own, n1, n2, n3, coalesce(LIKES(n1, '^[-–—:| ]*$'), false) AS dash1
    FROM (SELECT user_id AS page, event_id AS pos, t, lead(t, 1) OVER v AS n1, lead(t, 2) OVER v AS n2, lead(t, 3) OVER v AS n3 FROM (SELECT user_id, event_id, {forms('event_id', 'Values Last Updated - October 5th, 2026', 'at 12:49 PM', 'Values Last Updated', '-', 'May 1st, 2026', 'text', 'Values Last Updated - May 2, 2026 3:10', 'at 9')} AS t FROM $events$) q WINDOW v AS (PARTITION BY user_id ORDER BY event_id)) r
    WHERE t LIKE 'Values Last Updated%') s) z""")
_JSON = forms("p_partkey", '{"value": #, "name": "a"}', '{"price": {"amount": "12.5"}, "title": "b"}', '{"val": "7", "offers": {"price": 3}}', '{"name": "c", "offers": {"price": "4.25"}}', "not json {", '{"ask": 3, "bid": 2}')
_add("json_first_values", "Of the keys that a field can have the first with a number; the product's name; a mid rate of ask and bid.", f"""
SELECT p_partkey, CAST(coalesce(FOUND(JSONV(j, '$.value'), '^[0-9.]+$', 0), FOUND(JSONV(j, '$.val'), '^[0-9.]+$', 0), FOUND(JSONV(j, '$.price.amount'), '^[0-9.]+$', 0), FOUND(JSONV(j, '$.offers.price'), '^[0-9.]+$', 0)) AS DOUBLE) AS value, coalesce(JSONV(j, '$.name'), JSONV(j, '$.title')) AS name,
  round((CAST(FOUND(JSONV(j, '$.ask'), '^[0-9.]+$', 0) AS DOUBLE) + CAST(FOUND(JSONV(j, '$.bid'), '^[0-9.]+$', 0) AS DOUBLE)) / 2, 4) AS mid
FROM (SELECT p_partkey, CASE WHEN t LIKE '%}}' THEN t END AS j FROM (SELECT p_partkey, {_JSON} AS t FROM $part$) q) r""")
_add("canonical_items", "Item rows: a range within the value split off, N/A ranges empty, numbers with their suffix.", f"""
SELECT p_partkey, CASE WHEN lower(rng) = 'n/a' THEN NULL ELSE rng END AS range_, CAST(replace(FOUND(val, '^[0-9][0-9,]*', 0), ',', '') AS BIGINT) * CASE WHEN LIKES(val, '[kK]$') THEN 1000 WHEN LIKES(val, '[mM]$') THEN 1000000 ELSE 1 END AS value
FROM (SELECT p_partkey, coalesce(FOUND(t, '\\[(.*?)\\]', 1), '') AS rng, trim(SUBST(t, '\\[.*?\\]', '')) AS val FROM (SELECT p_partkey, {forms('p_partkey', '12 [10 - 15]', '3k', '1,200', '[N/A] 7', '5M', 'none')} AS t FROM $part$) q) r""")
_add("merged_cards", "Cards of one link: the best fit to the slug, then the fullest, then the shortest; what it lacks comes from cards of the same name.", """
SELECT link, card, coalesce(price, max(price) OVER (PARTITION BY name_)) AS price FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY fit DESC, filled DESC, size_, card) AS k
  FROM (SELECT p_partkey % 500 AS link, p_partkey AS card, p_name AS name_, p_size % 3 AS fit, CASE WHEN p_size % 4 > 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 > 0 THEN 1 ELSE 0 END AS filled, length(p_name) AS size_, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS price FROM $part$) c) d WHERE k = 1""")

#: Words of a name that a line is searched for, at most.
NAME_WORDS = 5
#: Names up to this number go to each task; more of them meet the runs by a shuffle.
HELD_NAMES = 100_000
CUTOFF = 0.82


def _lines(spark, sf_dir: str) -> DataFrame:
    """Lines with names, quantities and words between them: two parts of an order by turns."""
    part = table(spark, sf_dir, "part")
    pair = part.select(F.col("p_partkey").alias("line"), F.concat_ws(" ", F.concat(F.lit("x"), F.col("p_size")), "p_name", F.when(F.col("p_partkey") % 3 == 0, "and"), F.upper("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("text"))
    return pair


def scan_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """line, place, name, qty: names (column key) found in lines, at each word the longest one, up to NAME_WORDS words.

    A quantity token before a name is its quantity. Runs of words meet the names by an equi-join; the choice among
    overlapping ones is a fold over those of a line. Lines are dealt to tasks before they become runs, some thirty a line,
    and are never broadcast, however small their file is.
    """
    known = names.select("key").distinct()
    known = F.broadcast(known) if known.limit(HELD_NAMES + 1).count() <= HELD_NAMES else known.hint("merge")
    words = lines.repartition("line").select("line", F.split(F.lower(F.trim("text")), " +").alias("w"))
    runs = words.select("line", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("s")).select("line", "w", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(NAME_WORDS), F.size("w") - F.col("s") + 1))).alias("n"))
    runs = runs.select("line", "s", "n", F.array_join(F.slice("w", F.col("s"), F.col("n")), " ").alias("key"), F.when(F.col("s") > 1, F.element_at("w", F.when(F.col("s") > 1, F.col("s") - 1).otherwise(1))).alias("prev"))
    hits = runs.join(known, "key")
    found = hits.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("n")).alias("m"), "key", "prev"))).alias("h"))  # bounded by the words of a line
    none = F.filter("h", lambda x: F.lit(False))
    fold = F.aggregate("h", F.struct(F.lit(0).alias("end"), none.alias("got")), lambda a, x: F.when(x["s"] > a["end"], F.struct((x["s"] - x["m"] - 1).alias("end"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a))
    one = found.select("line", F.posexplode(fold["got"]).alias("place", "x"))
    qty = F.regexp_extract(F.coalesce("x.prev", F.lit("")), r"^x([0-9]{1,4})$", 1)
    return one.withColumn("q", qty).select("line", "place", F.col("x.key").alias("name"), F.when(F.col("q") != "", F.col("q").cast("int")).otherwise(1).alias("qty"))


def line_scan(spark, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("key")).union(table(spark, sf_dir, "part").select(F.lower("p_type").alias("key")))
    return scan_lines(_lines(spark, sf_dir), names)


QUERIES["line_scan"] = line_scan


def close_names(asked: DataFrame, names: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """asked, name, score: for each distinct asked text the closest name of at least ``cutoff`` (twice the matching
    characters over all), ties to the smaller name. Texts that are a name are found by an equi-join.

    Two texts of five or more characters that are so close have two neighbouring characters in common, and shorter
    ones meet by a character, so candidates come from an equi-join; lengths rule out more of them.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    asked, names = asked.select("asked").where("asked is not null").distinct(), names.select("name").where("name is not null").distinct()
    exact = asked.join(names, F.col("asked") == F.col("name")).select("asked", "name", F.lit(1.0).alias("score"))
    rest = asked.join(names, F.col("asked") == F.col("name"), "left_anti")

    def grams(c: str) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2)))
        single = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(1)))
        return F.explode(F.array_distinct(F.when(F.length(c) < 9, F.concat(pairs, single)).otherwise(pairs)))

    near = rest.withColumn("g", grams("asked")).join(names.withColumn("g", grams("name")), "g").where(2 * F.least(F.length("asked"), F.length("name")) >= cutoff * (F.length("asked") + F.length("name"))).select("asked", "name").distinct()
    scored = near.withColumn("score", ratio("asked", "name")).where(F.col("score") >= cutoff)
    best = scored.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("m"), "name")).alias("x")).select("asked", "x.name", (-F.col("x.m")).alias("score"))
    return exact.unionByName(best)


def fuzzy_match(spark, sf_dir: str) -> DataFrame:
    """Names with a letter lost or changed, against the names of the parts."""
    part = table(spark, sf_dir, "part")
    k = (F.col("p_partkey") % (F.length("p_name") + 1)).cast("int")
    asked = part.select(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.substring("p_name", F.lit(1), k), F.substring("p_name", k + 2, F.length("p_name")))).otherwise(F.concat(F.substring("p_name", F.lit(1), k), F.lit("q"), F.substring("p_name", k + 2, F.length("p_name")))).alias("asked"))
    return close_names(asked, part.select(F.col("p_name").alias("name")))


QUERIES["fuzzy_match"] = fuzzy_match
