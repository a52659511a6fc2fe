"""Queries that SQL can't say, against plain Python on small tables."""

import difflib
import random

from pyspark.sql import functions as F

from lotwise.operators import lines, matching, tiles

SF = "/root/testdata/sf0.001"


def greedy(pairs):
    used_i, used_j, out = set(), set(), set()
    for fit, i, j, g in sorted(pairs):
        if (g, i) not in used_i and (g, j) not in used_j:
            used_i.add((g, i))
            used_j.add((g, j))
            out.add((i, j, fit))
    return out


def test_tiles_paired_against_brute_force(spark):
    pairs = [(r.cost, r.name_id, r.badge_id, r.shot) for r in tiles.QUERIES["names_beside_badges"](spark, SF).collect()]
    assert {(r.name_id, r.badge_id, r.cost) for r in tiles.QUERIES["tiles_paired"](spark, SF).collect()} == greedy(pairs)


def test_assign_greedy_against_brute_force(spark):
    s, c = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("supplier", "customer"))
    pairs = [(round(abs(y.c_acctbal - x.s_acctbal), 2), x.s_suppkey, y.c_custkey, x.s_nationkey) for x in s for y in c if x.s_nationkey == y.c_nationkey and abs(y.c_acctbal - x.s_acctbal) <= 500]
    got = matching.QUERIES["assign_greedy"](spark, SF)
    assert {tuple(r)[:2] for r in got.collect()} == {x[:2] for x in greedy(pairs)}


def test_close_names_against_all_pairs(spark):
    names = ["Ice Wing", "Icewing", "Seer", "Elderwood Scythe", "Corrupt", "Gem", "Eve", "Bat", "ab"]
    asked = ["Ice Wlng", "Seer", "Sear", "Elderwod Scythe", "Corupt", "Gom", "Evve", "bat", "zzz", "", None, "ba", "Ice  Wing"]
    got = {r.asked: (r.name, round(r.score, 9)) for r in lines.close_names(spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    want = {}
    for a in {x for x in asked if x is not None}:
        best = min((-difflib.SequenceMatcher(None, n, a).ratio(), n) for n in names)
        if -best[0] >= lines.CUTOFF:
            want[a] = (best[1], round(-best[0], 9))
    assert got == want
    assert lines.QUERIES["fuzzy_match"](spark, SF).count() > 50


def test_line_scan_against_a_plain_scan(spark):
    rows = lines._lines(spark, SF).collect()
    part = spark.read.parquet(f"{SF}/part.parquet").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).collect()
    names = {r.a for r in part} | {r.b for r in part}
    want = set()
    for r in rows:
        w, s, place = r.text.lower().split(), 0, 0
        while s < len(w):
            n = next((n for n in range(min(lines.NAME_WORDS, len(w) - s), 0, -1) if " ".join(w[s : s + n]) in names), 0)
            if n:
                before = w[s - 1] if s else ""
                want.add((r.line, place, " ".join(w[s : s + n]), int(before[1:]) if before[:1] == "x" and before[1:].isdigit() else 1))
                place += 1
            s += n or 1
    assert {tuple(r) for r in lines.QUERIES["line_scan"](spark, SF).collect()} == want


def test_nearest_pairs_make_no_pairs_and_take_what_the_greedy_order_takes(spark):
    r = random.Random(5)
    for most, low, high, kinds in ((3.0, 0, 12, 1), (0.05, 0, 40, 0.01), (500.0, -90, 900, 7.13)):
        sides = [[(g, 10 * r.randrange(10_000) + g, float(round(r.randrange(low, high) * kinds, 2))) for g in range(3) for _ in range(40)] for _ in "lr"]
        sides = [list({x[:2]: x for x in rows}.values()) for rows in sides]
        free, want = [set(x[:2] for x in rows) for rows in sides], set()
        for fit, i, j, g in sorted((round(abs(b[2] - a[2]), 2), a[1], b[1], a[0]) for a in sides[0] for b in sides[1] if a[0] == b[0] and abs(b[2] - a[2]) <= most):
            if (g, i) in free[0] and (g, j) in free[1]:
                free[0].remove((g, i))
                free[1].remove((g, j))
                want.add((i, j, fit))
        left, right = (spark.createDataFrame([*rows, (None, 1, 0.0), (1, 2, None), (1, 3, float("nan"))], "g int, id long, value double") for rows in sides)
        got = matching.nearest_pairs(left, right, most)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    none = left.where("false")
    assert matching.nearest_pairs(none, right, 1.0).collect() == [] and matching.nearest_pairs(none, none, 1.0).collect() == []


def test_a_shortlist_copies_few_vectors_at_a_time():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    rows, asked = np.round(rng.normal(size=(3_000, 64)), 1), np.round(rng.normal(size=(tiles.ASKED, 64)), 1)
    rows[:1_500, :8] = np.round(rows[:1_500, :8])  # equal quick scores
    ids, own, labels = np.arange(3_000), np.arange(0, 10 * tiles.ASKED, 10), np.zeros(3_000, object)
    held = tiles.Shortlist(asked, tiles.SHORT)
    tracemalloc.start()
    for k in range(0, 3_000, 1_000):
        held.meet(ids[k : k + 1_000], labels[k : k + 1_000], rows[k : k + 1_000], own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
    for k in (0, 1, 700, tiles.ASKED - 1):
        quick = np.round(sum(rows[:, c] * asked[k, c] for c in range(tiles.QUICK)), 9)
        best = sorted((-v, n) for v, n in zip(quick, ids, strict=True) if n != own[k])[: tiles.SHORT]
        assert held.row[held.q == k].tolist() == [n for _, n in best]


def test_line_scan_never_broadcasts_lines(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "x3 Ice Wing and seer"), (2, "none"), (3, None)], "line long, text string")
    names = spark.range(2_000).select(F.concat(F.lit("name "), "id").alias("key")).union(spark.createDataFrame([("ice wing",), ("seer",)], "key string"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = lines.scan_lines(asked, names)
    assert "BuildRight" in plan(found) and "BuildLeft" not in plan(found)
    want = sorted(map(tuple, found.collect()))
    assert want == [(1, 0, "ice wing", 3), (1, 1, "seer", 1)]
    monkeypatch.setattr(lines, "HELD_NAMES", 10)
    found = lines.scan_lines(asked, names)
    assert "BroadcastHashJoin" not in plan(found) and sorted(map(tuple, found.collect())) == want
