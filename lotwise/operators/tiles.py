"""Tiles of a screenshot: words to runs, rows and reading order, badges beside names, votes, quantities, and pictures by likeness.

Words and boxes are events: a shot is a user, places come from the event's number and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .both import check_text, forms, register, spark_text
from .common import table
from .matching import greedy_pairs

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, doc: str, text: str, told: str | None = None) -> None:
    register(QUERIES, ORACLES, name, doc, text, told)


_WORDS = "(SELECT user_id AS shot, event_id AS id, event_type AS word, CAST(floor(value * 7) % 400 AS BIGINT) AS x, CAST(floor(value) % 90 AS BIGINT) AS y, 8 + event_id % 13 AS w, 6 + event_id % 5 AS h FROM $events$)"
#: Fixed values, in heights of the larger word: a wider gap, or a larger jump of the centre, begins a run; so does a larger ratio of heights.
GAP, JUMP, SIZES = 0.8, 0.45, 1.8


def runs_of_words(words: DataFrame, line: list[str]) -> DataFrame:
    """Words (id, x, y, w, h and the columns that name a line) with ``run``: the number of their run in the line, from 1.

    Words are taken from left to right, ties by id. A word begins a run if it is the first, or by GAP, JUMP and SIZES
    against the word before. A line's words are sorted in one task: it is a line of one picture.
    """
    w = Window.partitionBy(*line).orderBy("x", "id")
    before = {c: F.lag(c).over(w) for c in "xywh"}
    high, low = F.greatest("h", before["h"]), F.greatest(F.lit(1), F.least("h", before["h"]))
    apart = (F.col("x") - before["x"] - before["w"] > GAP * high) | (F.abs(F.col("y") + F.col("h") / 2 - before["y"] - before["h"] / 2) > JUMP * high) | (high > SIZES * low)
    return words.withColumn("_begins", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("run", F.sum("_begins").over(w)).drop("_begins")


def words_to_runs(spark, sf_dir: str) -> DataFrame:
    """Words of a line to runs."""
    words = spark.sql(spark_text(f"SELECT *, CAST(floor(y / 10) AS BIGINT) AS line FROM {_WORDS} a"), events=table(spark, sf_dir, "events"))
    return runs_of_words(words, ["shot", "line"]).select("shot", "id", "run")


QUERIES["words_to_runs"] = words_to_runs
ORACLES["words_to_runs"] = check_text(f"""
SELECT shot, id, CAST(sum(begin_) OVER (PARTITION BY shot, line ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
FROM (SELECT *, CASE WHEN px IS NULL OR x - px - pw > 8e-1 * greatest(h, ph) OR abs(y + h / 2e0 - py - ph / 2e0) > 4.5e-1 * greatest(h, ph) OR greatest(h, ph) > 1.8e0 * greatest(1, least(h, ph)) THEN 1 ELSE 0 END AS begin_
  FROM (SELECT *, lag(x) OVER v AS px, lag(w) OVER v AS pw, lag(y) OVER v AS py, lag(h) OVER v AS ph FROM (SELECT *, CAST(floor(y / 10) AS BIGINT) AS line FROM {_WORDS} a) b WINDOW v AS (PARTITION BY shot, line ORDER BY x, id)) c) d""")
_ROWS = f"(SELECT *, CAST(sum(new_) OVER (PARTITION BY shot ORDER BY c, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_ FROM (SELECT *, CASE WHEN lag(c) OVER v IS NULL OR abs(c - lag(c) OVER v) > 5e-1 * greatest(h, lag(h) OVER v) THEN 1 ELSE 0 END AS new_ FROM (SELECT *, y + h / 2e0 AS c FROM {_WORDS} a) b WINDOW v AS (PARTITION BY shot ORDER BY c, id)) d)"
_add("rows_by_distance", "Boxes to rows: one joins the row of the box before it, by the height of their centres.", f"SELECT shot, id, row_ FROM {_ROWS} r")
_add("reading_order", "Boxes in reading order: by row, then from left to right.", f"SELECT shot, id, row_number() OVER (PARTITION BY shot ORDER BY row_, x, id) AS place FROM {_ROWS} r")
_add("tile_pitches", "The pitch of the tiles of a shot: median of the distances of neighbours in a row up to one and a half of the least.", f"""
SELECT shot, CAST(median(gap) AS DOUBLE) AS pitch, min(gap) AS least FROM (SELECT shot, gap, min(gap) OVER (PARTITION BY shot) AS low FROM (SELECT shot, (x + w / 2e0) - lag(x + w / 2e0) OVER (PARTITION BY shot, row_ ORDER BY x + w / 2e0, id) AS gap FROM {_ROWS} r) g WHERE gap > 0) p WHERE gap <= 1.5e0 * low GROUP BY shot""")
_add("votes_by_region", "Badge votes of a region: full ones and half ones; two are needed, and a strict lead.", """
SELECT user_id, qty, votes FROM (SELECT user_id, qty, votes, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, qty) AS k, coalesce(lead(votes) OVER (PARTITION BY user_id ORDER BY votes DESC, qty), 0e0) AS next_
  FROM (SELECT user_id, CAST(floor(value) % 9 AS BIGINT) AS qty, CAST(sum(CASE WHEN event_type = 'error' THEN 5e-1 ELSE 1e0 END) AS DOUBLE) AS votes FROM $events$ GROUP BY 1, 2) v) r WHERE k = 1 AND votes >= 2 AND votes > next_""")
_add("votes_with_ties", "The name of a place by votes: named ones first, then more votes, the better score, the earlier pass.", """
SELECT user_id, name_, votes FROM (SELECT user_id, name_, votes, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN name_ IS NULL THEN 1 ELSE 0 END, votes DESC, value DESC, event_id) AS k
  FROM (SELECT user_id, event_id, value, name_, CASE WHEN name_ IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY user_id, name_) END AS votes FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS name_ FROM $events$) e) v) r WHERE k = 1""")
_talkative = lambda k, order: f"""
SELECT user_id, max_by(event_type, {order}) AS pass_ FROM (SELECT user_id, event_type, CAST(sum(length(props)) AS BIGINT) AS n, {k} AS k FROM $events$ GROUP BY user_id, event_type) q GROUP BY user_id"""  # noqa: E731
# the remainder repeats after a thousand events: of passes with as much text and one remainder the one that began later
_add("talkative_pass", "The pass with the most text.", _talkative("CAST(min(event_id) % 1000 AS BIGINT)", "n * 1000 + k"), _talkative("min(event_id)", "CASE WHEN n * 1000 + k IS NOT NULL THEN struct(n * 1000 + k % 1000, k) END"))
_add("quantities_summed", "Quantities of an item over the lines that name it, the least score, and the number of forms seen.", """
SELECT l_partkey, CAST(sum(floor(l_quantity)) AS BIGINT) AS qty, min(l_discount) AS score, count(DISTINCT l_returnflag) AS forms FROM $lineitem$ GROUP BY l_partkey""")
_add("first_in_order", "The first price and the first number of lots of a text, in line order.", """
SELECT l_orderkey, min_by(l_extendedprice, n) AS price, min_by(l_quantity, CASE WHEN l_returnflag = 'R' THEN n END) AS lots FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n FROM $lineitem$) q GROUP BY l_orderkey""")


def row_background(spark, sf_dir: str) -> DataFrame:
    """A profile of a picture's rows: gaps filled from before, then from behind, then the upper median of seven rows."""
    e = table(spark, sf_dir, "events").withColumn("good", F.when(F.col("event_type") != "error", F.col("value")))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.last("good", ignorenulls=True).over(order)
    behind = F.first("good", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = e.withColumn("filled", F.coalesce(before, behind))
    seven = F.sort_array(F.collect_list("filled").over(order.rowsBetween(-3, 3)))
    return rows.select("user_id", "event_id", F.element_at(seven, (F.floor(F.size(seven) / 2) + 1).cast("int")).alias("ground"))


QUERIES["row_background"] = row_background
ORACLES["row_background"] = """
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'error' THEN value END AS good FROM events),
f AS (SELECT user_id, event_id, ts, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM e),
l AS (SELECT user_id, event_id, list_sort(list(filled) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS s FROM f)
SELECT user_id, event_id, s[len(s) // 2 + 1] AS ground FROM l"""
_add("reference_sources", "Reference pictures to compute: the market's before the site's, all for items with variants, one for the others.", """
SELECT p_partkey, source FROM (SELECT p_partkey, p_size, source, row_number() OVER (PARTITION BY p_partkey ORDER BY source) AS k FROM (SELECT DISTINCT p.p_partkey, p.p_size, l.l_suppkey % 3 AS source FROM $part$ p JOIN $lineitem$ l ON l.l_partkey = p.p_partkey) q) r WHERE k = 1 OR p_size % 5 = 0""")
_add("prior_applied", "Likeness scores with the banner's categories: others count 0.92 of theirs, and the order is made anew.", """
SELECT user_id, event_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, event_id) AS place
FROM (SELECT user_id, event_id, value / 1e3 * CASE WHEN event_type IN ('click', 'view') THEN 1e0 ELSE 9.2e-1 END AS score FROM $events$) q""")
_add("banner_learned", "What banners of a bucket have been: the category if two or more were counted and it has 80 % of them.", """
SELECT bucket, category, n, total FROM (SELECT bucket, category, n, CAST(sum(n) OVER (PARTITION BY bucket) AS BIGINT) AS total, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, category) AS k
  FROM (SELECT bucket, category, CAST(least(count(*), 1000000) AS BIGINT) AS n FROM (SELECT p_size * 100 + p_partkey % 60 AS bucket, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END AS category FROM $part$) p GROUP BY bucket, category) c) d WHERE k = 1 AND total >= 2 AND n / (total * 1e0) >= 8e-1""")
_add("variant_decided", "The picture's item, if its score is 0.8 or more and leads that of the next other item by 0.08; else none.", """
SELECT user_id, CASE WHEN score >= 8e-1 AND score - coalesce(second_, 0e0) >= 8e-2 THEN item END AS item FROM (SELECT user_id, item, score, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, item) AS second_, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS k
  FROM (SELECT user_id, event_type AS item, max(value) / (SELECT max(value) FROM $events$) AS score FROM $events$ GROUP BY user_id, event_type) s) r WHERE k = 1""")
_add("names_beside_badges", "Names and the badges that can belong to them: above and to the right, at the distances of one tile; cost is the squared distance from the usual place, in half points.", f"""
SELECT n.shot, n.id AS name_id, b.id AS badge_id, CAST(pow(2 * (b.x + b.w - n.x) - n.w - 36, 2) + pow(2 * (n.y - b.y) + n.h - b.h - 80, 2) AS BIGINT) AS cost
FROM {_WORDS} n JOIN {_WORDS} b ON n.shot = b.shot AND b.x + b.w - n.x - n.w / 2e0 BETWEEN 6 AND 32 AND n.y + n.h / 2e0 - b.y - b.h / 2e0 BETWEEN 28 AND 58 WHERE n.word <> 'error' AND b.word = 'error'""")
_LINES = f"(SELECT user_id AS doc, event_id AS pos, t, FOUND(t, '^[xX×]?([0-9]{{1,4}})[xX×]?$', 1) AS only_, t = '' OR LIKES(t, '^[-=*. ]+$') AS noise FROM (SELECT user_id, event_id, {forms('event_id', 'x3', 'Ice Wing', '', 'Seer', '12', '---', 'x7', 'Candy Cane', 'Elder', '5x', 'Gem')} AS t FROM $events$) f)"
_add("text_lines_carry", "A line with a quantity alone counts for the item on the next line of a name, the last such line before it; one at the end for the last item.", f"""
WITH marked AS (SELECT doc, pos, t, only_, CASE WHEN only_ IS NULL AND NOT noise THEN 1 ELSE 0 END AS item FROM {_LINES} l),
grouped AS (SELECT *, CAST(sum(item) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) - item AS BIGINT) AS g, sum(item) OVER (PARTITION BY doc) AS items FROM marked),
folded AS (SELECT doc, g, max(items) AS items, max(CASE WHEN item = 1 THEN t END) AS name_, CAST(max_by(only_, CASE WHEN only_ IS NOT NULL THEN pos END) AS BIGINT) AS pending FROM grouped GROUP BY doc, g)
SELECT a.doc, a.g AS line, a.name_, greatest(1, coalesce(a.pending, z.pending, 1)) AS qty FROM folded a LEFT JOIN folded z ON a.doc = z.doc AND z.g = z.items AND a.g = a.items - 1 WHERE a.name_ IS NOT NULL""")

#: Axes of the cheap score, rows of the shortlist, answers; asked vectors that a task holds at a time.
QUICK, SHORT, TOP, ASKED = 8, 60, 5, 2048
#: Pairs that a task scores at a time: their vectors are copied side by side.
SCORED = 16_384


class Shortlist:
    """The best rows that a task has met for each asked vector: quick score, then the smaller id."""

    def __init__(self, asked: np.ndarray, most: int):
        self.asked, self.most = asked, most
        self.q, self.quick, self.row, self.label, self.score = (np.zeros(0, t) for t in (np.int64, float, np.int64, object, float))
        self.least = np.full(len(asked), -np.inf)

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        quick = np.zeros((len(rows), len(self.asked)))
        for k in range(min(QUICK, rows.shape[1])):  # the same order of sums in every batch
            quick += np.multiply.outer(rows[:, k], self.asked[:, k])
        quick = np.round(quick, 9)
        hits = (quick >= self.least) & (ids[:, None] != own[None, :])
        if len(rows) > self.most and np.count_nonzero(hits) > SCORED:  # what the batch's own best leave behind isn't among the best of all
            hits &= quick >= np.partition(np.where(hits, quick, -np.inf), len(rows) - self.most, axis=0)[len(rows) - self.most]
        i, q = np.nonzero(hits)
        size = np.einsum("ij,ij->i", rows, rows)[i] * np.einsum("ij,ij->i", self.asked, self.asked)[q]
        dot = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", rows[i[k : k + SCORED]], self.asked[q[k : k + SCORED]]) for k in range(0, len(i), SCORED))])
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(dot / np.sqrt(size), 6)
        q, value, row, label, score = (np.concatenate(x) for x in ((self.q, q), (self.quick, quick[i, q]), (self.row, ids[i]), (self.label, labels[i]), (self.score, score)))
        order = np.lexsort((row, -value, q))
        q = q[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = order[rank < self.most]
        last = order[rank == self.most - 1]
        self.least[q[rank == self.most - 1]] = value[last]
        self.q, self.quick, self.row, self.label, self.score = q[rank < self.most], value[keep], row[keep], label[keep], score[keep]


def embedding_topk(spark, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100 the most alike of all others: 60 by a cheap score (the product of
    the first axes), ranked again by the cosine, the best of each label, five of them. The asked vectors are a stated
    set, taken in blocks of ASKED; each block reads every row once, a task keeps 60 for each, and only those meet."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    asked = rows.where("vec_id % 100 = 0")
    blocks = max(1, -(-asked.count() // ASKED))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    near = None
    for b in range(blocks):
        held = asked.where(block == b).select("vec_id", "e").toArrow()  # about ASKED vectors
        if not held.num_rows:
            continue
        found = rows.mapInArrow(_shortlists(np.asarray(held.column(0)), held.column(1)), "q long, quick double, vec_id long, label int, score double")
        near = found if near is None else near.unionByName(found)
    if near is None:
        near = spark.createDataFrame([], "q long, quick double, vec_id long, label int, score double")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("quick"), "vec_id"))).where(F.col("k") <= SHORT)
    best = near.groupBy("q", "label").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "label"))).where(F.col("place") <= TOP).select("q", "label", "score", "place")


def _shortlists(own: np.ndarray, asked: pa.ChunkedArray):
    vectors = np.array(asked.to_pylist(), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shortlist(vectors, SHORT)
        for b in batches:
            for k in range(0, b.num_rows, 1_000):
                part = b.slice(k, 1_000)
                held.meet(np.asarray(part.column(0)), np.array(part.column(1).to_pylist(), object), np.array(part.column(2).to_pylist(), float), own)
        yield pa.RecordBatch.from_arrays([pa.array(own[held.q], pa.int64()), pa.array(held.quick), pa.array(held.row, pa.int64()), pa.array(held.label.tolist(), pa.int32()), pa.array(held.score)], names=["q", "quick", "vec_id", "label", "score"])

    return run


QUERIES["embedding_topk"] = embedding_topk
ORACLES["embedding_topk"] = f"""
WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id, a.label, a.e, b.vec_id AS q, b.e AS f, round(list_dot_product(a.e[1:{QUICK}], b.e[1:{QUICK}]), 9) AS quick FROM r a JOIN r b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY quick DESC, vec_id) <= {SHORT}),
g AS (SELECT q, label, max(round(list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)), 6)) AS score FROM s GROUP BY q, label)
SELECT q, label, score, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) AS place FROM g) WHERE place <= {TOP}"""


def tiles_paired(spark, sf_dir: str) -> DataFrame:
    """Names and badges of each shot, one to one, the least costs first."""
    near = QUERIES["names_beside_badges"](spark, sf_dir)
    return greedy_pairs(near.select(F.col("shot").alias("g"), F.col("name_id").alias("i"), F.col("badge_id").alias("j"), F.col("cost").alias("fit"))).select(F.col("i").alias("name_id"), F.col("j").alias("badge_id"), F.col("fit").alias("cost"))


QUERIES["tiles_paired"] = tiles_paired
