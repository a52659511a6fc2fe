"""How offers fit the items of their name: the misfit of a pair, the best ones, linked products and variants.

Every operator takes items and offers as tables of their own, so that any catalogue and any market can be asked; the
queries call them on stand-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .both import check_text, spark_text
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}

#: Categories of weapons, of which neighbours can be taken for each other, and those that no holiday offer belongs to.
LADDER = ("commons", "uncommons", "rares", "legendaries", "godlies", "ancients")
VALUABLE = ("godlies", "ancients", "uniques", "chromas", "vintages", "legendaries", "pets", "sets")
#: Columns of an item besides ``item`` and ``name_key``, and of an offer besides ``offer`` and ``name_key``. ``pet_class`` and ``rarity`` are rarities by one name.
ITEM = "category string, years array<int>, kind string, pet_class string, picture string"
OFFER = "expected string, rarity string, year int, offer_kind string, price double, popularity double, stock long, offer_picture string"


def offer_fit(item: dict[str, Column], offer: dict[str, Column]) -> Column:
    """The misfit of an item (columns of ITEM) and an offer (columns of OFFER): less is better, null is another item for certain."""
    own, kind = item["category"], offer["offer_kind"]
    no = lambda c: F.coalesce(c, F.lit(False))
    pet = no((own == "pets") | ((own == "chromas") & (kind == "pet")))
    expected = F.when(pet, own).otherwise(offer["expected"])

    def step(c: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, name in enumerate(LADDER):
            out = F.when(c == name, k).otherwise(out)
        return out

    other = no(expected != own) | (expected.isNotNull() & own.isNull())
    neighbour = no(F.abs(step(expected) - step(own)) == 1)
    event = no(offer["rarity"] == "event")
    impossible = (
        (pet & (no(kind.isin("gun", "knife")) | (no(offer["expected"] == "chromas") != no(own == "chromas"))))
        | (~pet & no(kind == "pet")) | (other & ~neighbour) | (expected.isNull() & event & no(own.isin(*VALUABLE)))
    )
    pets = F.when(F.coalesce(item["pet_class"] == offer["rarity"], F.lit(None).cast("boolean")), 0).when(item["pet_class"] != offer["rarity"], 30).otherwise(5) + F.when(no(kind == "pet"), 0).otherwise(3)
    dated = no(F.size(item["years"]) > 0)
    year = F.when(dated, F.when(offer["year"].isNull(), 10).when(F.array_contains(item["years"], offer["year"]), -20).otherwise(50)).when(offer["year"].isNotNull(), 3).otherwise(0)
    points = F.when(pet, pets).otherwise(0) + F.when(other, 60).otherwise(0) + F.when(expected.isNull(), F.when(event, 10).otherwise(5)).otherwise(0) + year
    points = points + F.when(no(item["kind"] != kind), 40).otherwise(0) - F.when(no((item["picture"] != "") & (item["picture"] == offer["offer_picture"])), 200).otherwise(0) + F.when(offer["price"].isNull(), 2).otherwise(0)
    return F.when(~impossible, points + F.coalesce(offer["popularity"], F.lit(1.0)) - F.when(offer["stock"].isNotNull(), F.least(offer["stock"], F.lit(1000)) / 1000).otherwise(0.0))  # least skips nulls


def fit_pairs(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Every offer with every item of its name_key, and their misfit (``fit``). Null names meet nothing; pairs stay within a name."""
    pairs = items.withColumnRenamed("name_key", "_key").join(offers.hint("merge"), F.col("_key") == F.col("name_key")).drop("_key")
    names = lambda spec: [c.split()[0] for c in spec.split(", ")]
    return pairs.withColumn("fit", offer_fit({c: F.col(c) for c in names(ITEM)}, {c: F.col(c) for c in names(OFFER)}).cast("double"))


def explained(pairs: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` offers of each item's name that fit best, those that can't fit last, with their place."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("fit").asc_nulls_last(), "offer"))
    return pairs.withColumn("place", place).where(F.col("place") <= most)


def linked_first(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """item, offer, linked: the offer that a user linked (item, offer), else the best that fits and that nobody linked. Of several links of an item the one with the largest offer counts."""
    chosen = links.groupBy("item").agg(F.max("offer").alias("offer"))
    own = chosen.select(F.col("item").alias("_i"))
    free = pairs.where("fit is not null").join(chosen.select(F.col("offer").alias("_o")).distinct(), F.col("offer") == F.col("_o"), "left_anti").join(own, F.col("item") == F.col("_i"), "left_anti")
    best = free.groupBy("item").agg(F.min(F.struct("fit", "offer")).alias("x")).select("item", "x.offer", F.lit(False).alias("linked"))
    return chosen.select("item", "offer", F.lit(True).alias("linked")).unionByName(best)


def best_offers(items: DataFrame, offers: DataFrame) -> DataFrame:
    """item, fit, offer: of the offers of an item's name_key that can be it the best by misfit, then the smallest offer, without making the pairs.

    Items and offers that the misfit can't tell apart meet once, and of offers that differ in popularity and stock alone
    those that can be the best. As any two may have one picture, pictures are met apart: first every kind of offer as
    if it had no picture, which never makes a misfit less, then those of the item's own picture.
    """
    items, offers = items.hint("merge"), offers.hint("merge")  # a small file can be many rows: none is broadcast
    ease = F.coalesce("popularity", F.lit(1.0)) - F.when(F.col("stock").isNotNull(), F.least("stock", F.lit(1000)) / 1000).otherwise(0.0)
    told = offers.where("name_key is not null").withColumns({"_priced": F.col("price").isNotNull(), "_ease": ease})

    def kinds(rows: DataFrame, *more: str) -> DataFrame:
        own = ["name_key", "expected", "rarity", "year", "offer_kind", "_priced", *more]
        one = rows.groupBy(*own, "popularity", "stock", "_ease").agg(F.min("price").alias("price"), F.min("offer").alias("offer"))
        least = F.min("_ease").over(Window.partitionBy(*own))
        return one.withColumn("_least", least).where(F.col("_ease") <= F.col("_least") + 1e-9 * (1000 + F.abs("_least")))  # sums of doubles round

    def best(rows: DataFrame, own: list[str], kinds_: DataFrame, into: str) -> DataFrame:
        pairs = fit_pairs(rows.groupBy(*own).agg(F.lit(1).alias("_")).withColumn("_item", F.struct(*own)).withColumns({c: F.lit(None).cast("string") for c in ("picture",) if c not in own}), kinds_)
        pairs = pairs.where("fit is not null" + (" and picture = offer_picture" if "picture" in own else ""))
        return pairs.groupBy("_item").agg(F.min(F.struct("fit", "offer")).alias(into))

    plain = ["name_key", "category", "years", "kind", "pet_class"]
    seen = [*plain, "picture"]
    named = items.where("name_key is not null")
    first = best(named, plain, kinds(told).withColumn("offer_picture", F.lit(None).cast("string")), "_plain")
    same = best(named.where("picture <> ''"), seen, kinds(told.where("offer_picture <> ''"), "offer_picture"), "_seen")
    rows = named.withColumns({"_a": F.struct(*plain), "_b": F.struct(*seen)})
    rows = rows.join(first, F.col("_a") == F.col("_item"), "left").drop("_item").join(same, F.col("_b") == F.col("_item"), "left")
    return rows.groupBy("item").agg(F.min(F.least("_plain", "_seen")).alias("x")).where("x is not null").select("item", "x.fit", "x.offer")


def linked_best(items: DataFrame, offers: DataFrame, links: DataFrame) -> DataFrame:
    """``linked_first`` of all pairs of a name, without making the pairs."""
    chosen = links.groupBy("item").agg(F.max("offer").alias("offer")).hint("merge")
    free = offers.join(chosen.select(F.col("offer").alias("_o")).distinct(), F.col("offer") == F.col("_o"), "left_anti")
    asked = items.join(chosen.select(F.col("item").alias("_i")), F.col("item") == F.col("_i"), "left_anti")
    return chosen.select("item", "offer", F.lit(True).alias("linked")).unionByName(best_offers(asked, free).select("item", "offer", F.lit(False).alias("linked")))


def _variant_rank(exact: Column) -> Column:
    miss = lambda right: F.when(F.coalesce(right, F.lit(False)), 0).otherwise(1)
    return F.struct(
        miss(F.col("expected").isNull() | (F.col("expected") == F.col("category"))).alias("a"), miss((F.size("years") <= 0) | F.col("years").isNull() | F.array_contains("years", F.col("year"))).alias("b"),
        miss(F.col("price").isNotNull()).alias("c"), miss(exact).alias("d"), F.coalesce("popularity", F.lit(1.0)).alias("e"), (-F.coalesce("stock", F.lit(0))).alias("f"), F.col("offer").alias("offer"),
    )


def variants(pairs: DataFrame, exact: Column) -> DataFrame:
    """item, offer: the variant by rarity, year, price, ``exact`` name, popularity and stock, in this order."""
    return pairs.groupBy("item").agg(F.min(_variant_rank(exact)).alias("x")).select("item", "x.offer")


def best_variants(items: DataFrame, offers: DataFrame) -> DataFrame:
    """``variants`` of all pairs of a name without making the pairs; the exact name is the offer that is the item itself.

    Items of one category and years meet the first offer of each kind once; the item's own offer is met by its key.
    """
    items, offers = items.hint("merge"), offers.hint("merge")
    named, own = items.where("name_key is not null"), ["name_key", "category", "years"]
    order = F.struct(F.coalesce("popularity", F.lit(1.0)), -F.coalesce("stock", F.lit(0)), "offer")
    first = offers.groupBy("name_key", "expected", "year", F.col("price").isNotNull()).agg(F.min_by(F.struct("price", "popularity", "stock", "offer"), order).alias("x")).select(F.col("name_key").alias("_key"), "expected", "year", "x.*")
    kinds = named.groupBy(*own).agg(F.lit(1).alias("_")).join(first, F.col("name_key") == F.col("_key"))
    best = kinds.groupBy(F.struct(*own).alias("_kind")).agg(F.min(_variant_rank(F.lit(False))).alias("x"))
    met = named.withColumn("_k", F.struct(*own)).join(best, F.col("_k") == F.col("_kind")).select("item", "x")
    self_ = offers.select(F.col("name_key").alias("_key"), "offer", "expected", "year", "price", "popularity", "stock")
    exact = named.join(self_, (F.col("item") == F.col("offer")) & (F.col("name_key") == F.col("_key"))).select("item", _variant_rank(F.lit(True)).alias("x"))
    return met.unionByName(exact).groupBy("item").agg(F.min("x").alias("x")).select("item", "x.offer")


# -- stand-ins: items are parts, offers of a name are the parts of the same name, kind and brand ----------------------

_ITEMS = """(SELECT p_partkey AS item, concat(p_name, p_type, p_brand) AS name_key, CASE p_size % 8 WHEN 0 THEN 'pets' WHEN 1 THEN 'chromas' WHEN 2 THEN 'commons' WHEN 3 THEN 'uncommons' WHEN 4 THEN 'rares' WHEN 5 THEN 'legendaries' WHEN 6 THEN 'godlies' ELSE 'ancients' END AS own,
  CASE WHEN p_partkey % 3 = 0 THEN 2015 + p_size % 6 END AS item_year, CASE p_partkey % 4 WHEN 0 THEN 'gun' WHEN 1 THEN 'knife' END AS item_kind, CASE p_partkey % 5 WHEN 0 THEN 'rare' WHEN 1 THEN 'common' END AS item_class, p_partkey % 17 AS picture FROM $part$)"""
_OFFERS = """(SELECT p_partkey AS offer, concat(p_name, p_type, p_brand) AS name_key, CASE p_partkey % 9 WHEN 0 THEN 'godlies' WHEN 1 THEN 'legendaries' WHEN 2 THEN 'rares' WHEN 3 THEN 'chromas' WHEN 4 THEN 'commons' WHEN 5 THEN 'ancients' END AS expected, CASE WHEN p_partkey % 11 = 0 THEN 'event' WHEN p_partkey % 9 < 5 THEN 'rare' END AS rarity,
  CASE WHEN p_partkey % 4 = 1 THEN 2015 + p_partkey % 6 END AS offer_year, CASE p_partkey % 6 WHEN 0 THEN 'pet' WHEN 1 THEN 'gun' WHEN 2 THEN 'knife' END AS kind, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS price, p_size % 10 / 1e1 AS popularity, CASE WHEN p_size % 3 > 0 THEN p_size * 40 END AS stock, p_partkey % 19 AS picture FROM $part$)"""


def _sides(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    items = spark.sql(spark_text(f"SELECT item, name_key, own AS category, array_compact(array(item_year)) AS years, item_kind AS kind, item_class AS pet_class, CAST(picture AS STRING) AS picture FROM {_ITEMS} i"), part=part)
    offers = spark.sql(spark_text(f"SELECT offer, name_key, expected, rarity, offer_year AS year, kind AS offer_kind, price, popularity, stock, CAST(picture AS STRING) AS offer_picture FROM {_OFFERS} o"), part=part)
    return items, offers


def _pairs(spark, sf_dir: str) -> DataFrame:
    return fit_pairs(*_sides(spark, sf_dir))


def offer_fit_pairs(spark, sf_dir: str) -> DataFrame:
    """Every offer with every item of its name, and its misfit."""
    return _pairs(spark, sf_dir).select("item", "offer", F.round("fit", 6).alias("fit"))


def fit_explained(spark, sf_dir: str) -> DataFrame:
    """The eight offers of an item's name that fit it best, those that can't fit last."""
    return explained(_pairs(spark, sf_dir)).select("item", "offer", F.round("fit", 6).alias("fit"), "place")


def linked_first_query(spark, sf_dir: str) -> DataFrame:
    """The offer of each item: the one that a user linked, else the best that nobody linked and that fits."""
    items, offers = _sides(spark, sf_dir)
    # a user links each pair whose 7 * item + offer is divisible by 23; of an item the largest offer counts
    last = offers.groupBy(F.col("name_key").alias("_key"), F.pmod("offer", F.lit(23)).alias("_rest")).agg(F.max("offer").alias("offer")).hint("merge")
    links = items.join(last, (F.col("name_key") == F.col("_key")) & (F.pmod(F.col("item") * -7, F.lit(23)) == F.col("_rest"))).select("item", "offer")
    return linked_best(items, offers, links)


def variant_rank_full(spark, sf_dir: str) -> DataFrame:
    """The variant of an item by rarity, year, price, exact name, popularity and stock, in this order."""
    return best_variants(*_sides(spark, sf_dir))


QUERIES |= {"offer_fit_pairs": offer_fit_pairs, "fit_explained": fit_explained, "linked_first": linked_first_query, "variant_rank_full": variant_rank_full}

# The check's SQL, one case after another: whether a pair is possible, then its points.
_SQL_PAIRS = check_text(f"""(SELECT p.*, CASE WHEN possible THEN
    CASE WHEN NOT is_pet THEN 0 WHEN item_class IS NULL OR rarity IS NULL THEN 5 WHEN item_class = rarity THEN 0 ELSE 30 END + CASE WHEN is_pet AND kind IS DISTINCT FROM 'pet' THEN 3 ELSE 0 END
    + CASE WHEN is_pet THEN 0 WHEN expected IS NULL THEN CASE WHEN rarity = 'event' THEN 10 ELSE 5 END WHEN expected <> own THEN 60 ELSE 0 END
    + CASE WHEN item_year IS NULL AND offer_year IS NULL THEN 0 WHEN item_year IS NULL THEN 3 WHEN offer_year IS NULL THEN 10 WHEN item_year = offer_year THEN -20 ELSE 50 END
    + CASE WHEN item_kind <> kind THEN 40 ELSE 0 END - CASE WHEN item_picture = picture THEN 200 ELSE 0 END + CASE WHEN price IS NULL THEN 2 ELSE 0 END + popularity - CASE WHEN stock IS NULL THEN 0 WHEN stock > 1000 THEN 1 ELSE stock / 1000 END END AS fit
  FROM (SELECT q.*, CASE WHEN is_pet THEN kind NOT IN ('gun', 'knife') IS NOT FALSE AND (expected IS NOT DISTINCT FROM 'chromas') = (own = 'chromas')
      WHEN kind = 'pet' THEN false WHEN expected IS NULL THEN NOT (rarity IS NOT DISTINCT FROM 'event' AND own IN ('godlies', 'ancients', 'uniques', 'chromas', 'vintages', 'legendaries', 'pets', 'sets'))
      WHEN expected = own THEN true ELSE coalesce(abs(list_position(rungs, expected) - list_position(rungs, own)) = 1 AND list_contains(rungs, expected) AND list_contains(rungs, own), false) END AS possible
    FROM (SELECT i.item, i.own, i.item_year, i.item_kind, i.item_class, i.picture AS item_picture, o.*, own = 'pets' OR (own = 'chromas' AND kind IS NOT DISTINCT FROM 'pet') AS is_pet, ['commons', 'uncommons', 'rares', 'legendaries', 'godlies', 'ancients'] AS rungs FROM {_ITEMS} i JOIN {_OFFERS} o ON i.name_key = o.name_key) q) p)""")
ORACLES["offer_fit_pairs"] = f"SELECT item, offer, round(fit, 6) AS fit FROM {_SQL_PAIRS} f"
ORACLES["fit_explained"] = f"SELECT item, offer, round(fit, 6) AS fit, row_number() OVER (PARTITION BY item ORDER BY fit NULLS LAST, offer) AS place FROM {_SQL_PAIRS} f QUALIFY place <= 8"
ORACLES["linked_first"] = f"""
WITH pairs AS MATERIALIZED (SELECT item, offer, fit FROM {_SQL_PAIRS} f), links AS (SELECT item, max(offer) AS offer FROM pairs WHERE (item * 7 + offer) % 23 = 0 GROUP BY item)
SELECT item, offer, true AS linked FROM links UNION ALL
SELECT item, arg_min(offer, [fit, offer]) AS offer, false AS linked FROM pairs WHERE fit IS NOT NULL AND offer NOT IN (SELECT offer FROM links) AND item NOT IN (SELECT item FROM links) GROUP BY item"""
ORACLES["variant_rank_full"] = f"""
SELECT item, offer FROM (SELECT item, offer, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN expected IS NULL OR expected = own THEN 0 ELSE 1 END, CASE WHEN item_year IS NULL OR item_year = offer_year THEN 0 ELSE 1 END,
  CASE WHEN price IS NULL THEN 1 ELSE 0 END, CASE WHEN item = offer THEN 0 ELSE 1 END, popularity, -coalesce(stock, 0), offer) AS k FROM {_SQL_PAIRS} f) r WHERE k = 1"""
