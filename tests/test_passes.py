"""Clusters of boxes against the loop that takes one box after another, and glued names against all cuts."""

import random

from pyspark.sql import functions as F

from lotwise.operators.passes import neighbours, place_clusters, split_glued
from lotwise.operators.products import LEAST, read_names


def close(a, b):
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    ix, iy = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
    inter = max(0, ix) * max(0, iy)
    if inter / (aw * ah + bw * bh - inter) >= 0.3:
        return True
    return abs(ay + ah / 2 - by - bh / 2) < 0.5 * min(ah, bh) and ix >= 0.5 * min(aw, bw)


def loop(boxes):
    groups = []
    for n, box in boxes:
        for g in groups:
            if any(close(box, other) for _, other in g):
                g.append((n, box))
                break
        else:
            groups.append([(n, box)])
    return {n: g[0][0] for g in groups for n, _ in g}


def test_clusters_equal_the_sequential_loop(spark):
    r = random.Random(4)
    shots = {}
    for shot in [1, 2, 3, None]:
        boxes = [(float(r.randrange(0, 120)), float(r.randrange(-20, 60)), float(r.choice([6, 12, 12, 40, 300])), float(r.choice([5, 8, 8, 20, 90]))) for _ in range(70)]
        boxes += boxes[:10]  # ties
        shots[shot] = list(enumerate(r.sample(boxes, len(boxes))))
    shots[9] = [(k, (6.0 * k, 0.0, 12.0, 10.0)) for k in range(40)]  # each overlaps the next: one cluster, by a long chain
    odd = [(5, 0, 1.0, 1.0, 0.0, 5.0), (5, 1, 1.0, 1.0, None, 5.0), (5, 2, None, 1.0, 2.0, 5.0)]
    rows = [(s, n, *b) for s, boxes in shots.items() for n, b in boxes] + odd
    table = spark.createDataFrame(rows, "shot long, n long, x double, y double, w double, h double").withColumn("before", F.lit("clash"))
    got, rounds = place_clusters(table)
    want = {(s, n): c for s, boxes in shots.items() for n, c in loop(boxes).items()} | {(5, k): k for k in range(3)}
    assert {(x.shot, x.n): x.cluster for x in got.collect()} == want
    assert rounds <= 8  # not one for each link of the chain
    assert place_clusters(table.limit(0))[0].count() == 0


def test_glued_names_equal_all_cuts(spark):
    r = random.Random(8)
    names = ["Cowboy", "Seer", "Ice Wing", "Elderwood Scythe", "Corrupt", "Chroma Seer", "Wing", "Red Seer", "Candy Set", "Gem"]
    keys = ["".join(c for c in n.lower() if c.isalnum()) for n in names]
    phrases = []
    for _ in range(120):
        words = " ".join(r.choice(names) for _ in range(r.randrange(1, 5))).split()[:8]
        words = [w if r.random() < 0.7 else r.choice([w[:-1], w.replace("o", "0"), w.replace("m", "rn"), "!", w + "x"]) for w in words]
        phrases.append(words)
    phrases += [["Elderwood", "Scythe", "Corrupt"], ["nothing", "like", "it"], [], None, ["word"] * 300 + ["Seer", "Cowboy"], ["Seer", "Cowboy"]]
    table = spark.createDataFrame(list(enumerate(phrases)), "phrase long, words array<string>").withColumn("name", F.lit("clash")).withColumn("size", F.lit("clash"))
    key = lambda words: "".join(c for c in "".join(words).lower() if c.isascii() and c.isalnum())
    runs = {key(w[i:j]) for w in phrases if w and len(w) < 20 for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    scores = {x.asked: (x.name, x.score) for x in read_names(spark.createDataFrame([(k,) for k in runs], "asked string"), spark.createDataFrame([(k,) for k in keys], "name string")).collect()}

    def split(words, at=0):
        name, whole = scores.get(key(words), (None, None))
        best = None
        if (whole or 0) < 0.9:
            for i in range(1, len(words)):
                a, b = scores.get(key(words[:i])), scores.get(key(words[i:]))
                if a and b and min(a[1], b[1]) > max(whole or 0, LEAST) and (best is None or min(a[1], b[1]) > best[0]):
                    best = (min(a[1], b[1]), i)
        if best is None:
            return [(at, len(words), " ".join(words), name, whole)]
        return split(words[: best[1]], at) + split(words[best[1] :], at + best[1])

    want = sorted((i, *x) for i, w in enumerate(phrases) if w and len(w) < 20 for x in split(w))
    want.append((124, 0, 302, " ".join(phrases[124]), None, None))
    got = sorted(tuple(x) for x in split_glued(table, spark.createDataFrame([(k,) for k in keys], "name string")).collect())
    assert got == sorted(want, key=lambda x: x[:2])
    assert [x[3] for x in got if x[0] == 120] == ["Elderwood Scythe", "Corrupt"]


def test_neighbours_and_steps_join_without_a_broadcast(spark, tmp_path):
    from lotwise.operators.common import reread

    boxes = spark.createDataFrame([(1, n, 10.0 * n, 0.0, 12.0, 8.0) for n in range(4)], "shot long, n long, x double, y double, w double, h double")
    boxes.write.parquet(f"{tmp_path}/boxes")
    held = reread(boxes, f"{tmp_path}/boxes")
    plans = [neighbours(boxes), held.join(held.groupBy("n").count(), "n"), held.join(held.select("n").where("n > 1"), "n", "left_anti")]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
