"""Rules with values that were worked out by hand from their definitions, not by their own text."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import scoring, text
from lotwise.operators import fit, history, tiles


def asked(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], f"k int, {schema}").orderBy("k").select(*[c.alias(n) for n, c in columns.items()]).collect()]


@pytest.mark.parametrize(("field", "yes", "no"), [
    ("stability", ["Stable", "Doing Well", "Overpaid For", "overpaid for 3 days", "Underpaid For", "Improving", "Declining", "Peaking", "Dropping", "Receding", "Rising", "Fluctuating", " N/A"], ["Overpriced", "Underpriced", "Ice Wing", "", None, "not stable"]),
    ("value", ["12", "~ 1,320", "x 5", "Priceless", "N/A", "untradable", "None", "?"], ["Ice Wing", "", None, "xenon"]),
    ("range", ["[10 - 15]", "(5", "n/a"], ["x5", "Seer"]), ("demand", ["7", "N/A", "na"], ["seven", "(7)"]), ("rarity", ["3"], ["Rare"]),
    ("change", ["(+3)", "[-2]", "+1", "−5", "-5", "0", "n/a"], ["up", None]), ("origin", ["Halloween 2019"], ["", "  ", None]),
])
def test_values_of_fields(spark, field, yes, no):
    got = asked(spark, [(t,) for t in yes + no], "t string", fits=text.value_fits(field, F.col("t")))
    assert [g[0] for g in got] == [True] * len(yes) + [False] * len(no)


def test_verdicts_of_parses(spark):
    cases = [((0, 0, 5, False, False), "empty"), ((0, 0, 50, True, True), "empty"), ((20, 2, 0, False, False), "taken"), ((20, 3, 0, False, False), "orphans"), ((20, 3, 0, True, True), "orphans"), ((40, 4, 40, False, False), "taken"),
             ((40, 5, 40, False, False), "orphans"), ((4, 0, 10, False, False), "shrank"), ((5, 0, 10, False, False), "taken"), ((4, 0, 9, False, False), "taken"), ((4, 0, 10, True, False), "taken"), ((4, 0, 10, None, True), "taken"), ((None, None, None, None, None), "empty")]
    got = asked(spark, [c for c, _ in cases], "items int, orphans int, before int, imported boolean, repeated boolean", v=scoring.parse_verdict(*map(F.col, ("items", "orphans", "before", "imported", "repeated"))))
    assert [g[0] for g in got] == [v for _, v in cases]


def test_reasons_of_refreshes(spark):
    cases = [((True, 0, None, 1, None, "a"), "paused"), ((False, 0, 10, 1, "a", "a"), "empty"), ((False, 5, None, 0, "a", "a"), "old"), ((False, 5, 43_201, 0, "a", "a"), "old"), ((False, 5, 43_200, 0, "a", "a"), "same"),
             ((False, 5, 899, 1, "a", "a"), "same"), ((False, 5, 900, 1, "a", "a"), "errors"), ((False, 5, 1_700, 2, "b", "a"), "errors"), ((False, 5, 10, 0, None, "a"), "no date"), ((False, 5, 10, 0, "b", "a"), "changed"), ((False, 5, 10, 0, "b", None), "changed")]
    got = asked(spark, [c for c, _ in cases], "paused boolean, items int, age int, errors int, site string, own string", v=scoring.refresh_reason(*map(F.col, ("paused", "items", "age", "errors", "site", "own"))))
    assert [g[0] for g in got] == [v for _, v in cases]


def test_runs_of_words(spark):
    # heights of ten: a gap of eight stays, one of nine parts; so do a jump of five and a height of nineteen
    words = [(1, 0, 0, 20, 10), (2, 28, 0, 20, 10), (3, 57, 0, 20, 10), (4, 78, 4, 20, 10), (5, 99, 9, 20, 10), (6, 120, 9, 20, 18), (7, 141, 9, 20, 34)]
    rows = spark.createDataFrame([(1, *w) for w in words] + [(2, 1, 5, 0, 3, 3)], "line int, id int, x int, y int, w int, h int")
    got = {(r.line, r.id): r.run for r in tiles.runs_of_words(rows, ["line"]).collect()}
    assert [got[1, k] for k in range(1, 8)] == [1, 1, 2, 2, 3, 3, 4] and got[2, 1] == 1


BASE = {"category": "godlies", "years": None, "kind": None, "pet_class": None, "picture": None, "expected": None, "rarity": None, "year": None, "offer_kind": None, "price": 1.0, "popularity": 0.0, "stock": None, "offer_picture": None}


def test_misfits_of_offers(spark):
    cases = [
        ({"expected": "godlies"}, 0), ({"expected": "godlies", "popularity": None}, 1), ({"expected": "godlies", "price": None}, 2), ({"expected": "godlies", "stock": 250}, -0.25), ({"expected": "godlies", "stock": 5_000}, -1),
        ({"expected": "ancients"}, 60), ({"category": "ancients", "expected": "godlies"}, 60), ({"expected": "legendaries"}, 60), ({"expected": "rares"}, None), ({"expected": "chromas"}, None), ({"category": "sets", "expected": "godlies"}, None),
        ({}, 5), ({"rarity": "event"}, None), ({"category": "commons", "rarity": "event"}, 10), *[({"category": c, "rarity": "event"}, None) for c in ("ancients", "uniques", "chromas", "vintages", "legendaries", "sets")], ({"category": "rares", "rarity": "event"}, 10),
        ({"expected": "godlies", "years": [2015, 2016], "year": 2016}, -20), ({"expected": "godlies", "years": [2015], "year": 2016}, 50), ({"expected": "godlies", "years": [2015]}, 10), ({"expected": "godlies", "years": [], "year": 2016}, 3),
        ({"expected": "godlies", "kind": "gun", "offer_kind": "knife"}, 40), ({"expected": "godlies", "kind": "gun", "offer_kind": "gun"}, 0), ({"expected": "godlies", "kind": "gun"}, 0), ({"expected": "godlies", "offer_kind": "pet"}, None),
        ({"expected": "godlies", "picture": "seer", "offer_picture": "seer"}, -200), ({"expected": "godlies", "picture": "", "offer_picture": ""}, 0),
        ({"category": "pets", "offer_kind": "pet", "pet_class": "rare", "rarity": "rare"}, 0), ({"category": "pets", "offer_kind": "pet", "pet_class": "rare", "rarity": "godly"}, 30), ({"category": "pets", "offer_kind": "pet"}, 5), ({"category": "pets"}, 8),
        ({"category": "pets", "offer_kind": "gun"}, None), ({"category": "pets", "offer_kind": "pet", "expected": "chromas"}, None), ({"category": "chromas", "offer_kind": "pet", "expected": "chromas"}, 5), ({"category": "chromas", "offer_kind": "pet", "expected": "pets"}, None),
        ({"category": "pets", "offer_kind": "pet", "expected": "godlies", "rarity": "event"}, 5), ({"category": None, "expected": "godlies"}, None), ({"category": None}, 5),
    ]
    rows = [tuple((BASE | c).values()) for c, _ in cases]
    got = asked(spark, rows, f"{fit.ITEM}, {fit.OFFER}", v=fit.offer_fit({c.split()[0]: F.col(c.split()[0]) for c in fit.ITEM.split(", ")}, {c.split()[0]: F.col(c.split()[0]) for c in fit.OFFER.split(", ")}))
    assert [g[0] for g in got] == [v for _, v in cases]


def test_offers_of_a_catalogue(spark):
    items = spark.createDataFrame([(1, "seer", "godlies", None, None, None, None), (2, "bat", "rares", None, None, None, None), (3, None, "rares", None, None, None, None)], f"item long, name_key string, {fit.ITEM}")
    offers = spark.createDataFrame([(k, n, e, None, None, None, 1.0, p, None, None) for k, n, e, p in [(10, "seer", "godlies", 0.5), (11, "seer", "godlies", 0.2), (12, "seer", "rares", 0.0), (13, "bat", None, 0.1), (14, None, "rares", 0.1)]], f"offer long, name_key string, {fit.OFFER}")
    pairs = fit.fit_pairs(items, offers)
    assert sorted((r.item, r.offer, r.fit) for r in pairs.collect() if r.fit is not None) == [(1, 10, 0.5), (1, 11, 0.2), (2, 13, 5.1)]
    assert [(r.offer, r.place) for r in fit.explained(pairs).where("item = 1").orderBy("place").collect()] == [(11, 1), (10, 2), (12, 3)]
    assert [r.place for r in fit.explained(pairs, 1).collect()] == [1, 1]
    links = spark.createDataFrame([(2, 11)], "item long, offer long")
    assert sorted(map(tuple, fit.linked_first(pairs, links).collect())) == [(1, 10, False), (2, 11, True)]
    assert sorted(map(tuple, fit.variants(pairs, F.lit(False)).collect())) == [(1, 11), (2, 13)]


def test_idle_time_without_downtime(spark):
    day = 86_400
    # a poll each quarter of an hour; a night of ten hours without any between them
    times = [k * 900 for k in range(40)] + [40 * 900 + 36_000 + k * 900 for k in range(20)]
    polls = spark.createDataFrame([(m, t) for m in ("a", None) for t in times] + [("b", 0), ("b", 10 * day), ("b", None)], "market string, at long")
    seen = spark.createDataFrame([("a", 1, 0), ("a", 1, times[-1]), ("a", 2, times[39]), ("a", 3, times[0]), (None, 3, times[30]), ("b", 4, 0), ("b", 5, None)], "market string, product long, at long")
    got = {(r.market, r.product): (r.idle, r.state) for r in history.staleness(polls, seen).collect()}
    night = 36_900 - 1_800  # of the pause half an hour counts
    assert got == {("a", 1): (0, "shown"), ("a", 2): (times[-1] - times[39] - night, "shown"), ("a", 3): (times[-1] - night, "hidden"), (None, 3): (times[-1] - times[30] - night, "hidden"), ("b", 4): (1_800, "shown")}


def test_best_of_all_pairs_without_the_pairs(spark):
    import random

    r = random.Random(3)
    of = lambda *x: r.choice(x)
    names, kinds = ("seer", "bat", None), ("pets", "chromas", "godlies", "ancients", "legendaries", "rares", None)
    item = [(k, of(*names), of(*kinds), of(None, [], [2015], [2016, 2017]), of("gun", "knife", "pet", None), of("rare", "common", None), of("", "p1", "p2", "p3", None)) for k in range(80)]
    offer = [(k, of(*names), of(*kinds), of("event", "rare", "common", None), of(2015, 2016, None), of("gun", "pet", "knife", None), of(1.5, None), of(0.1, 0.3, 0.7, 1.0, None), of(100, 300, 5000, None), of("", "p1", "p2", "p4", None)) for k in range(160)]
    items, offers = spark.createDataFrame(item, f"item long, name_key string, {fit.ITEM}").cache(), spark.createDataFrame(offer, f"offer long, name_key string, {fit.OFFER}").cache()
    pairs = fit.fit_pairs(items, offers).cache()
    links = pairs.where("(item + offer) % 41 = 0").select("item", "offer")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(fit.linked_best(items, offers, links)) == told(fit.linked_first(pairs, links))
    assert told(fit.linked_best(items, offers, links.where("false"))) == told(fit.linked_first(pairs, links.where("false")))
    assert told(fit.best_variants(items, offers)) == told(fit.variants(pairs, F.col("item") == F.col("offer")))
    assert told(fit.best_offers(items, offers.where("false"))) == [] and told(fit.best_variants(items.where("false"), offers)) == []
