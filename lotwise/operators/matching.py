"""Matching offers to items: indexes by exact and loose names, cascades, choice among variants, one-to-one assignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import reread, scratch, table

QUERIES: dict = {}
ORACLES: dict = {}


def exact_loose_index(spark, sf_dir):
    """Loose keys of items (the name's key), kept only if one item has it within its size."""
    p = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("/", T.name_key(F.col("p_name")), "p_size"))
    return p.groupBy("key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1").select("key", "p_partkey")


QUERIES["exact_loose_index"] = exact_loose_index
ORACLES["exact_loose_index"] = "SELECT key, min(p_partkey) AS p_partkey FROM (SELECT *, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '/' || p_size AS key FROM part) GROUP BY key HAVING count(*) = 1"


def offer_lookup_cascade(spark, sf_dir):
    """Offers by key and size where that is unique, else by key and brand where that is."""
    p = table(spark, sf_dir, "part").withColumn("key", T.name_key(F.col("p_name")))

    def index(*by: str) -> DataFrame:
        return p.groupBy(*by).agg(F.count("*").alias("n"), F.min("p_partkey").alias("_hit")).where("n = 1").drop("n")

    exact, loose = index("key", "p_size").withColumnRenamed("_hit", "exact"), index("key", "p_brand").withColumnRenamed("_hit", "loose")
    return p.join(exact, ["key", "p_size"], "left").join(loose, ["key", "p_brand"], "left").select("p_partkey", F.coalesce("exact", "loose").alias("item"))


QUERIES["offer_lookup_cascade"] = offer_lookup_cascade
ORACLES["offer_lookup_cascade"] = """
WITH p AS (SELECT *, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part)
SELECT p_partkey, coalesce(CASE WHEN count(*) OVER (PARTITION BY key, p_size) = 1 THEN p_partkey END, CASE WHEN count(*) OVER (PARTITION BY key, p_brand) = 1 THEN p_partkey END) AS item FROM p"""


def variant_pick(spark, sf_dir):
    """Of items of one name the best by rank of type, then value (nulls last), then id."""
    rank = F.when(F.col("p_type").like("S%"), 0).when(F.col("p_type").like("P%"), 1).otherwise(2)
    w = Window.partitionBy("p_name").orderBy(rank, F.desc_nulls_last("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("k", F.row_number().over(w)).where("k = 1").select("p_name", "p_partkey")


QUERIES["variant_pick"] = variant_pick
ORACLES["variant_pick"] = "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_type LIKE 'S%' THEN 0 WHEN p_type LIKE 'P%' THEN 1 ELSE 2 END, p_retailprice DESC NULLS LAST, p_partkey) = 1"


def greedy_pairs(pairs: DataFrame, group: str = "g", keep_group: bool = False) -> DataFrame:
    """One-to-one assignment in each group: pairs (g, i, j, fit) in order of fit, i, j; each is taken if both are free.

    Null fits are impossible pairs. Taken in rounds: a pair that is the first of its i and the first of its j has none
    before it that could take either, so all such pairs are taken at once, and the pairs of what they use leave. The
    first pair of a group is always one of them. Rounds are written to the shared folder, with the pairs left in two
    places by turns.
    """
    spark = pairs.sparkSession
    path = scratch(spark, "greedy")
    left = pairs.where("fit IS NOT NULL").select(F.col(group).alias("g"), "i", "j", "fit").groupBy("g", "i", "j").agg(F.min("fit").alias("fit"))
    schema = left.schema
    left.write.parquet(f"{path}/left-0")
    left = reread(left, f"{path}/left-0")
    number = 0
    while True:
        first_i = left.groupBy("g", "i").agg(F.min(F.struct("fit", "j")).alias("x")).select("g", "i", "x.j", "x.fit")
        first_j = left.groupBy("g", "j").agg(F.min(F.struct("fit", "i")).alias("x")).select(F.col("g").alias("_g"), F.col("x.i").alias("_i"), F.col("j").alias("_j"))
        same = F.col("g").eqNullSafe(F.col("_g"))
        both = first_i.join(first_j, same & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left_semi")
        both.write.parquet(f"{path}/taken/{number}")
        taken = reread(left, f"{path}/taken/{number}")
        for c in ("i", "j"):
            left = left.join(taken.select(F.col("g").alias("_g"), F.col(c).alias("_c")), same & (F.col(c) == F.col("_c")), "left_anti")
        number += 1
        left.write.mode("overwrite").parquet(f"{path}/left-{number % 2}")
        left = reread(left, f"{path}/left-{number % 2}")
        if left.isEmpty():
            found = spark.read.schema(schema).parquet(f"{path}/taken/*")
            return found.select(*(["g"] if keep_group else []), F.col("i").cast("long"), F.col("j").cast("long"), F.col("fit").cast("double"))


def nearest_pairs(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """(i, j, fit) as ``greedy_pairs`` takes them of all pairs of a left and a right row (g, id, value) of a group that are
    at most ``most`` apart, without making these pairs; fit is the distance. An id has one value, in hundredths.

    Rows of one value are one node, and in each round a node knows its nearest nodes of the other side, one below and one
    above at most. Where a node and all its nearest have none nearer than each other, nothing before could take their
    rows: those of both sides are taken in order of their ids, one by one. Of nodes that hang together otherwise the
    pair that is the first of both its rows is taken. Neighbours are looked for in bands of values, no group is whole
    in a task; rows without a node within ``most`` leave, as they can't get one. Null, NaN and infinite values meet
    nothing, nor do null groups and ids.
    """
    path = scratch(left.sparkSession, "nearest")

    def step(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return reread(df, f"{path}/{name}")

    side = lambda rows, k: rows.select("g", F.lit(k).alias("side"), F.round(F.col("value") * 100).cast("long").alias("at"), F.col("value").cast("double").alias("value"), F.col("id").cast("long").alias("id"))
    rows = step(side(left, 0).unionByName(side(right, 1)).where("g is not null and id is not null and abs(value) < 1e13").distinct(), "rows")
    width = math.ceil(most * 100) + 1
    number = 0
    while True:
        nodes = rows.groupBy("g", "side", "at").agg(F.min("value").alias("value"), F.min("id").alias("first"))
        home = F.floor(F.col("at") / width)
        spread = nodes.withColumn("home", home).withColumn("band", F.explode(F.array(home - 1, home, home + 1)))

        def beside(*order):
            w = Window.partitionBy("g", "band").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            met = lambda k: F.last(F.when(F.col("side") == k, F.struct("at", "value", "first")), ignorenulls=True).over(w)
            return F.when(F.col("side") == 0, met(1)).otherwise(met(0))

        far = lambda c: F.when(F.abs(F.col("value") - F.col(f"{c}.value")) <= most, F.abs(F.col("at") - F.col(f"{c}.at")))
        told = spread.withColumns({"down": beside("at", "side"), "up": beside(F.desc("at"), F.desc("side"))}).where("band = home")
        told = told.withColumns({"_down": far("down"), "_up": far("up")}).withColumn("d", F.least("_down", "_up")).where("d is not null")
        to = F.array_compact(F.array(*[F.when(F.col(f"_{c}") == F.col("d"), F.col(c)) for c in ("down", "up")]))
        near = step(told.select("g", "side", "at", "value", "first", to.alias("to")), f"near-{number}")
        if near.isEmpty():
            taken = left.sparkSession.read.schema("g int, i long, j long, fit double").parquet(f"{path}/taken/*") if number else left.sparkSession.createDataFrame([], "i long, j long, fit double")
            return taken.select("i", "j", "fit")
        ends = near.select("*", F.size("to").alias("n"), F.explode("to").alias("t"))
        a = ends.where("side = 0").select("g", F.col("at").alias("l"), F.col("t.at").alias("r"), F.col("value").alias("lv"), F.col("t.value").alias("rv"), F.col("first").alias("i"), F.col("t.first").alias("j"), F.col("n").alias("ln"))
        b = ends.where("side = 1").select("g", F.col("at").alias("r"), F.col("t.at").alias("l"), F.col("first").alias("_j"), F.col("t.first").alias("_i"), F.col("n").alias("rn"))
        every = lambda own, other: F.min(F.when(F.col(own).isNotNull(), F.coalesce(F.col(other) == 1, F.lit(False))))
        of_l, of_r = Window.partitionBy("g", "l"), Window.partitionBy("g", "r")
        edges = a.join(b, ["g", "l", "r"], "full").withColumns({"lc": every("ln", "rn").over(of_l), "_bj": F.min("j").over(of_l)}).withColumns({"rc": every("rn", "ln").over(of_r), "_bi": F.min("_i").over(of_r)})
        edges = step(edges.where("ln is not null and rn is not null"), f"edges-{number}")
        stars = edges.where("lc or rc").select("g", "l", "r", F.when(F.col("lc"), 0).otherwise(1).alias("cs"), F.when(F.col("lc"), F.col("l")).otherwise(F.col("r")).alias("c"))
        members = stars.select("g", F.lit(0).alias("side"), F.col("l").alias("at"), "cs", "c").unionByName(stars.select("g", F.lit(1).alias("side"), F.col("r").alias("at"), "cs", "c")).distinct()
        ranked = rows.join(members, ["g", "side", "at"]).withColumn("k", F.row_number().over(Window.partitionBy("g", "cs", "c", "side").orderBy("id")))
        ours, theirs = (ranked.where(F.col("side") == k).select("g", "cs", "c", "k", F.col("id").alias(i), F.col("value").alias(v)) for k, i, v in ((0, "i", "lv"), (1, "j", "rv")))
        firsts = edges.where("not lc and not rc and j = _bj and i = _bi")
        took = ours.join(theirs, ["g", "cs", "c", "k"]).select("g", "i", "j", "lv", "rv").unionByName(firsts.select("g", "i", "j", "lv", "rv"))
        taken = step(took.select(F.col("g").cast("int").alias("g"), "i", "j", F.round(F.abs(F.col("rv") - F.col("lv")), 2).alias("fit")), f"taken/{number}")
        gone = taken.select("g", F.lit(0).alias("side"), F.col("i").alias("id")).unionByName(taken.select("g", F.lit(1).alias("side"), F.col("j").alias("id")))
        rows = step(rows.join(near.select("g", "side", "at"), ["g", "side", "at"], "left_semi").join(gone, ["g", "side", "id"], "left_anti"), f"rows-{number}")
        number += 1


def assign_greedy(spark, sf_dir):
    """Suppliers and customers of a nation, one to one: the nearest balances first, at most 500 apart."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    left, right = s.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), c.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    if left.unionByName(right).where("round(value, 2) <> value").isEmpty():
        return nearest_pairs(left, right, 500)
    near = c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.abs(F.col("c_acctbal") - F.col("s_acctbal")) <= 500))
    return greedy_pairs(near.select(F.col("c_nationkey").alias("g"), F.col("s_suppkey").alias("i"), F.col("c_custkey").alias("j"), F.round(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 2).alias("fit")))


QUERIES["assign_greedy"] = assign_greedy
