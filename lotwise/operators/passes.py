"""Texts that several passes read from one picture: boxes of one place in clusters, and glued names split.

Both are rounds of joins over all pictures at once; no picture is a group of its own in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reread, scratch, table
from .products import LEAST, read_names

QUERIES: dict = {}
ORACLES: dict = {}

#: Share of the union that two boxes of one place have in common, or else share of the smaller height between
#: their centres (less than) and of the smaller width that they have in common.
COMMON, BETWEEN, BESIDE = 0.3, 0.5, 0.5
#: A phrase that is a name with this score is not split; a half must be a name with more than LEAST.
WHOLE = 0.9


def same_place(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes (x, y, w, h) cover one text."""
    right, bottom = lambda c: c["x"] + c["w"], lambda c: c["y"] + c["h"]
    across = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    down = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    shared = F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    centre = F.abs(a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2)
    return (shared >= COMMON * union) | ((centre < BETWEEN * F.least(a["h"], b["h"])) & (across >= BESIDE * F.least(a["w"], b["w"])))


def _step(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return reread(df, path)


def neighbours(boxes: DataFrame, rule: Callable[[dict, dict], Column] = same_place) -> DataFrame:
    """(shot, n, before): the earlier boxes (by n) of each box's place. Boxes of one place overlap, so they meet in the cells of a grid.

    A box lies in the cells of its own size, four at most, and looks for others in cells of that size and larger ones:
    the smaller of two boxes finds the larger one.
    """
    level = F.ceil(F.log2(F.greatest("w", "h", F.lit(1.0)))).cast("int")
    cells = lambda size: F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col("x") / size), F.floor((F.col("x") + F.col("w")) / size)), lambda i: F.transform(F.sequence(F.floor(F.col("y") / size), F.floor((F.col("y") + F.col("h")) / size)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    rows = boxes.select("shot", "n", *[F.col(c).cast("double").alias(c) for c in "xywh"]).where("w > 0 and h > 0").withColumn("level", level)
    home = rows.withColumn("cell", cells(F.pow(F.lit(2.0), "level")))
    top = rows.agg(F.max("level").alias("_top"))  # one row
    look = rows.crossJoin(F.broadcast(top)).withColumn("at", F.explode(F.sequence("level", "_top"))).withColumn("cell", cells(F.pow(F.lit(2.0), "at")))
    a, b = look.alias("a"), home.hint("merge").alias("b")
    met = a.join(b, F.col("a.shot").eqNullSafe(F.col("b.shot")) & (F.col("a.at") == F.col("b.level")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.n") != F.col("b.n")))
    of = lambda s: {c: F.col(f"{s}.{c}") for c in "xywh"}
    near = met.where(rule(of("a"), of("b")))
    return near.select(F.col("a.shot").alias("shot"), F.greatest("a.n", "b.n").alias("n"), F.least("a.n", "b.n").alias("before")).distinct()


def place_clusters(boxes: DataFrame, path: str | None = None, rule: Callable[[dict, dict], Column] = same_place) -> tuple[DataFrame, int]:
    """(shot, n, cluster) of boxes (shot, n, x, y, w, h) and the number of rounds.

    Boxes are taken in the order of n: each joins the oldest cluster that holds a box of its place, else it begins one,
    which n of its first box names. ``rule`` says which boxes are of one place; such boxes have to overlap. So a box's cluster is the smallest n that leads from it from box to earlier box of
    one place: a box that has no earlier neighbour has itself, and in each round the others take the smallest of their
    neighbours', and of the box that they have so far. ``n`` is unique in a shot. Boxes without a size, or with a null
    in it, are clusters of their own; a null shot is a shot. An empty table gives an empty one.
    """
    spark = boxes.sparkSession
    path = path or scratch(spark, "clusters")
    edges = _step(neighbours(boxes, rule), f"{path}/edges")
    schema = "shot {}, n {}, cluster {}".format(*(boxes.schema[c].dataType.simpleString() for c in ("shot", "n", "n")))
    label = _step(boxes.select("shot", "n", F.col("n").alias("cluster")).to(spark.createDataFrame([], schema).schema), f"{path}/label-0")
    rounds = 0
    while True:
        of = lambda side, c: label.select(F.col("shot").alias("_s"), F.col("n").alias("_n"), F.col("cluster").alias(c))  # noqa: B023, E731
        near = edges.join(of(edges, "c"), F.col("shot").eqNullSafe(F.col("_s")) & (F.col("before") == F.col("_n"))).groupBy(F.col("shot").alias("es"), F.col("n").alias("en")).agg(F.min("c").alias("near"))
        step = label.join(near, F.col("shot").eqNullSafe(F.col("es")) & (F.col("n") == F.col("en")), "left").select("shot", "n", "cluster", F.least("cluster", "near").alias("new"))
        # the box that it has so far may itself have moved on
        far = step.join(of(step, "far"), F.col("shot").eqNullSafe(F.col("_s")) & (F.col("new") == F.col("_n")))
        rounds += 1
        moved = _step(far.select("shot", "n", F.col("cluster").alias("old"), F.least("new", "far").alias("cluster")), f"{path}/label-{rounds}")
        label = moved.select("shot", "n", "cluster")
        if moved.where("old <> cluster").isEmpty():
            return label, rounds


def _boxes(spark, sf_dir: str) -> DataFrame:
    """Boxes on a grid of tiles, read by four passes with a little shift; some are cut, some wide. A shot is a user's day."""
    e = table(spark, sf_dir, "events")
    k, j = F.col("event_id"), F.col("event_id") * 7919 % 97
    rows = e.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts") % 4).alias("shot"), k.alias("id"), (k % 5 == 0).alias("cut"),
        ((k * 13 % 4) * 40 + j % 11).cast("double").alias("x"), ((k * 7 % 3) * 25 + j % 7).cast("double").alias("y"), (F.lit(20) + j % 3 * 12).cast("double").alias("w"), (F.lit(8) + j % 5).cast("double").alias("h"),
    )
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("shot").orderBy("cut", F.desc("w"), "id")).cast("long"))


def pass_clusters(spark, sf_dir: str) -> DataFrame:
    """Boxes of all passes with their cluster: whole ones before those that are cut, wide ones first."""
    boxes = _boxes(spark, sf_dir)
    return place_clusters(boxes)[0]


QUERIES["pass_clusters"] = pass_clusters
ORACLES["pass_clusters"] = """
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY cut, w DESC, id) AS n FROM (SELECT user_id * 100 + day(ts) % 4 AS shot, event_id AS id, event_id % 5 = 0 AS cut,
  ((event_id * 13 % 4) * 40 + event_id * 7919 % 97 % 11)::DOUBLE AS x, ((event_id * 7 % 3) * 25 + event_id * 7919 % 97 % 7)::DOUBLE AS y, (20 + event_id * 7919 % 97 % 3 * 12)::DOUBLE AS w, (8 + event_id * 7919 % 97 % 5)::DOUBLE AS h FROM events) q),
p AS (SELECT a.shot, a.n, c.n AS before, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x) AS ox, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y) AS oy, a.w * a.h + c.w * c.h AS both_, abs(a.y + a.h / 2 - c.y - c.h / 2) AS dy, least(a.h, c.h) AS lh, least(a.w, c.w) AS lw FROM b a JOIN b c ON a.shot = c.shot AND c.n < a.n),
e AS (SELECT shot, n, before FROM p WHERE greatest(ox, 0) * greatest(oy, 0) >= 0.3 * (both_ - greatest(ox, 0) * greatest(oy, 0)) OR (dy < 0.5 * lh AND ox >= 0.5 * lw)),
r AS (SELECT shot, n, n AS upto FROM b UNION SELECT r.shot, r.n, e.before FROM r JOIN e ON e.shot = r.shot AND e.n = r.upto)
SELECT shot, n, min(upto) AS cluster FROM r GROUP BY shot, n"""


def split_glued(phrases: DataFrame, names: DataFrame, path: str | None = None) -> DataFrame:
    """(phrase, start, words, text, name, score): phrases (phrase, words: an array) as the names that are glued in them.

    A phrase stays whole if it is a name with WHOLE at least. Else it is cut where both parts are names with more than
    LEAST, and than the whole's score, so that the worse of the two is as good as can be, the first such cut; the
    parts are cut in the same way. Runs of words meet the names (column name, their keys) by ``read_names``, whose
    joins are on parts of the key; runs longer than any key can match are not formed. Null and empty phrases give no
    row, words whose key is empty belong to the run around them, repeated phrases have to differ in ``phrase``.
    """
    spark = phrases.sparkSession
    path = path or scratch(spark, "glued")
    key = F.regexp_replace(F.lower(F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), "")), "[^a-z0-9]+", "")
    longest = names.agg(F.max(F.length("name")).alias("_most"))  # one row
    count = F.size("words")
    runs = phrases.where(count > 0).crossJoin(F.broadcast(longest)).select("phrase", "words", "_most", F.explode(F.sequence(F.lit(0), count - 1)).alias("start"))
    # by the letters of the words before, so that no run is formed that is too long to match
    letters = F.transform("words", lambda w: F.length(F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")))
    reach = F.aggregate(F.slice(letters, F.col("start") + 1, count), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, x: F.struct((a["n"] + x).alias("n"), F.when(a["n"] + x <= F.col("_most") * (2 / LEAST - 1) + 1, a["k"] + 1).otherwise(a["k"]).alias("k")), lambda a: a["k"])
    runs = runs.withColumn("size", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), reach)))).select("phrase", "start", "size", key.alias("key"))
    runs = _step(runs, f"{path}/runs")
    found = read_names(runs.select(F.col("key").alias("asked")), names)
    scored = _step(runs.join(found, F.col("key") == F.col("asked")).select("phrase", "start", "size", "name", "score"), f"{path}/scored")
    parts = phrases.where(count > 0).select("phrase", F.lit(0).alias("start"), count.alias("size"))
    done, rounds = None, 0
    while True:
        whole = scored.select(F.col("phrase").alias("_p"), F.col("start").alias("_a"), F.col("size").alias("_n"), "name", "score")
        told = parts.join(whole, (F.col("phrase") == F.col("_p")) & (F.col("start") == F.col("_a")) & (F.col("size") == F.col("_n")), "left").select("phrase", "start", "size", "name", "score")
        left, right = scored.alias("l"), scored.alias("r")
        cuts = told.alias("t").join(left, (F.col("t.phrase") == F.col("l.phrase")) & (F.col("t.start") == F.col("l.start")) & (F.col("l.size") < F.col("t.size")))
        cuts = cuts.join(right, (F.col("t.phrase") == F.col("r.phrase")) & (F.col("r.start") == F.col("l.start") + F.col("l.size")) & (F.col("r.size") == F.col("t.size") - F.col("l.size")))
        worse = F.least("l.score", "r.score")
        ok = cuts.where((F.coalesce("t.score", F.lit(0.0)) < WHOLE) & (worse > F.greatest(F.coalesce("t.score", F.lit(0.0)), F.lit(LEAST))))
        best = ok.groupBy(F.col("t.phrase").alias("_p"), F.col("t.start").alias("_a")).agg(F.max(F.struct(worse.alias("score"), (-F.col("l.size")).alias("m"))).alias("x")).select("_p", "_a", (-F.col("x.m")).alias("cut"))
        rounds += 1
        now = _step(told.join(best, (F.col("phrase") == F.col("_p")) & (F.col("start") == F.col("_a")), "left").select("phrase", "start", "size", "name", "score", "cut"), f"{path}/parts-{rounds}")
        stays = now.where("cut is null").drop("cut")
        done = stays if done is None else done.unionByName(stays)
        open_ = now.where("cut is not null")
        if open_.isEmpty():
            break
        parts = open_.select("phrase", F.explode(F.array(F.struct(F.col("start").alias("start"), F.col("cut").alias("size")), F.struct((F.col("start") + F.col("cut")).alias("start"), (F.col("size") - F.col("cut")).alias("size")))).alias("x")).select("phrase", "x.start", "x.size")
    texts = phrases.select(F.col("phrase").alias("_p"), "words")
    return done.join(texts, F.col("phrase") == F.col("_p")).select("phrase", "start", F.col("size").alias("words"), F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ").alias("text"), "name", "score")


def glued_names(spark, sf_dir: str) -> DataFrame:
    """Names of two or three parts on one line, misread here and there, as the names in them."""
    part = table(spark, sf_dir, "part")
    misread = lambda c: F.when(F.col("p_size") % 3 == 0, F.replace(c, F.lit("o"), F.lit("0"))).when(F.col("p_size") % 3 == 1, F.replace(c, F.lit("m"), F.lit("rn"))).otherwise(c)
    text = F.concat_ws(" ", misread(F.col("p_name")), F.initcap("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))
    names = part.select(F.col("p_name").alias("n")).union(part.select(F.col("p_type").alias("n"))).select(F.regexp_replace(F.lower("n"), "[^a-z0-9]+", "").alias("name")).where("name <> ''").distinct()
    return split_glued(part.select(F.col("p_partkey").alias("phrase"), F.split(text, " +").alias("words")), names)


QUERIES["glued_names"] = glued_names
