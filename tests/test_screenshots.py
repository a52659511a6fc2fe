"""Screenshots as words: what is drawn is what is read, by forty tiles and four passes, and in the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import screenshots
from lotwise.operators.screenshots import PASSES, WORD, badge_quantity, chosen_items, fold_text, phrases, recognised, same_tiles, tile_widths

NAMES = ["Cowboy", "Seer", "Ice Wing", "Elderwood Scythe", "Corrupt", "Chroma Seer", "Candy Set", "Red Seer", "Gemstone", "Laser"]
COLOUR = (180, 40, 160)


def words_of(name, qty, left, top, passes=PASSES, size=1.0, colour=COLOUR, jitter=0.0, start=0, line="", cut=False, badge=None):
    """Words of one tile of 120 x 158, drawn at a size."""
    out = []
    for j, p in enumerate(passes):
        s, at, n = jitter * j, 60 - len(name) * 3.0, start
        for w in name.split():
            out.append((p, f"{line}n", n, w, left + at * size + s, top + 146 * size, len(w) * 6.0 * size, 15.0 * size, cut, *colour))
            at, n = at + (len(w) + 1) * 6.0, n + 1
        text = badge or f"x{qty}"
        if qty > 1:
            w = len(text) * 12.0 * size
            out.append((p, f"{line}b", n + 50, text, left + 116 * size - w + s, top + 10 * size, w, 15.0 * size, cut, *colour))
    return out


def grid(shot, tiles, columns, size=1.0, passes=PASSES, jitter=0.4):
    rows = []
    for k, (name, qty) in enumerate(tiles):
        r, c = divmod(k, columns)
        rows += [(shot, *w) for w in words_of(name, qty, (20 + c * 130) * size, (20 + r * 190) * size, passes, size, jitter=jitter, start=k * 100, line=f"{r}")]
    return rows


def read(spark, rows, names=NAMES, shots=None):
    table = spark.createDataFrame(rows, WORD).withColumn("name", F.lit("clash"))
    sizes = None if shots is None else spark.createDataFrame(shots, "shot long, width int, height int")
    return recognised(table, spark.createDataFrame([(n,) for n in names], "name string"), sizes).orderBy("shot", "place").collect()


def test_grids_are_read_as_they_are_drawn(spark):
    r = random.Random(3)
    big = [(NAMES[(i * 8 + c) * 7 % len(NAMES)], i + c + 2) for i in range(5) for c in range(8)]  # forty tiles, four passes
    some = [(r.choice(NAMES), r.choice([1, 1, 3, 40])) for _ in range(10)]
    small = [(r.choice(NAMES), r.choice([2, 9, 120])) for _ in range(12)]
    rows = grid(1, big, 8) + grid(2, some, 5) + grid(3, small, 4, size=0.5) + grid(None, [("Seer", 7), ("Cowboy", 1)], 2, passes=["color@2"])
    r.shuffle(rows)
    got = read(spark, rows)
    by = {}
    for t in got:
        by.setdefault(t.shot, []).append((t.name, t.qty))
    assert by == {1: big, 2: some, 3: small, None: [("Seer", 7), ("Cowboy", 1)]}
    assert all(t.score == 1.0 and not t.clipped and t.qty_from_badge == (t.qty > 1) for t in got)
    widths = {t.shot: t.w for t in got}
    assert abs(widths[1] - 122) <= 1 and abs(widths[3] - 61) <= 1


def test_misread_cut_and_stray_words(spark):
    dark = (30, 30, 34)
    rows = [(1, *w) for w in
            words_of("Cowb0y", 40, 20, 20, ["white"], line="a") + words_of("Cowboy", 4, 20, 20, ["grayinv", "color"], line="a", jitter=1.0, badge="x4O") + words_of("Cowboy", 40, 20, 20, ["whitehi"], line="a")
            + words_of("Elderwood Scythe", 3, 150, 20, line="b") + words_of("Back", 1, 280, 20, line="c", colour=dark) + words_of("Gemstone", 1, 410, 20, line="d", colour=dark)
            + words_of("Zzyzx Qwrt", 5, 540, 20, ["white"], line="e") + words_of("Qqq", 1, 670, 20, line="f")
            + [("white", "g", 900, "x", 800.0, 30.0, 8.0, 15.0, False, *COLOUR), ("white", "g", 901, "12", 812.0, 30.0, 24.0, 15.0, False, *COLOUR), ("white", "g", 902, "•", 850.0, 30.0, 5.0, 9.0, False, *COLOUR), ("white", "h", 903, "", 0.0, 0.0, 5.0, 9.0, False, *COLOUR), ("white", "h", 904, "Seer", 0.0, 0.0, 0.0, 9.0, False, *COLOUR)]]
    got = [(t.name, t.qty, t.text) for t in read(spark, rows, [*NAMES, "Black"])]
    assert [g[:2] for g in got] == [("Cowboy", 40), ("Elderwood Scythe", 3), ("Gemstone", 1), (None, 5), (None, 12)]  # a dark label needs to be sure, a text that is no name two passes; a badge is a tile
    assert got[3][2] == got[4][2] == ""


def test_the_border_of_a_screenshot(spark):
    tiles = [(1, *w) for w in words_of("Cowboy", 5, 20, 20, line="a") + words_of("Seer", 2, 150, 20, line="b") + words_of("Seer", 1, 345, 20, line="c") + words_of("Seer", 4, 345, 210, line="d") + words_of("Laser", 1, 20, -60, line="e")]
    got = [(t.name, t.qty, t.clipped, t.qty_uncertain) for t in read(spark, tiles, shots=[(1, 425, 500)])]
    # the third column is cut off: without a badge it is left to another screenshot, with one it has a number and no name
    assert got == [("Laser", 1, False, True), ("Cowboy", 5, False, False), ("Seer", 2, False, False), (None, 4, True, False)]


def test_glued_and_wide_names(spark):
    rows = [(1, *w) for w in words_of("Cowboy", 5, 20, 20, ["white"], line="a") + words_of("Seer", 2, 150, 20, ["white"], line="b")]
    glued = [("color", "z", 700, "Cowboy", 62.0, 166.4, 36.0, 15.0, False, *COLOUR), ("color", "z", 701, "Seer", 106.0, 166.4, 24.0, 15.0, False, *COLOUR)]
    got = {(t.name, t.qty) for t in read(spark, rows + [(1, *w) for w in glued])}
    assert {("Cowboy", 5), ("Seer", 2)} <= got and not any(n and " " in n for n, _ in got)


def test_parts_and_widths(spark):
    words = spark.createDataFrame(grid(1, [("Ice Wing", 3), ("Seer", 2)], 2, passes=["white"]), WORD)
    names, badges = phrases(words)
    assert sorted(" ".join(v.text for v in r.words) for r in names.collect()) == ["Ice Wing", "Seer"] and sorted(r.qty for r in badges.collect()) == [2, 3]
    one = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 10.0), (2, 1, 0.0, 0.0, 30.0, 10.0), (2, 2, 130.0, 1.0, 30.0, 10.0), (2, 3, 390.0, 2.0, 30.0, 10.0), (3, 1, 0.0, 0.0, 30.0, 50.0), (3, 2, 40.0, 0.0, 30.0, 50.0)], "shot int, n long, x double, y double, w double, h double")
    got = {r.shot: round(r.width, 2) for r in tile_widths(None, one).collect()}
    assert got == {1: 81.0, 2: 121.55, 3: 405.0}  # by height; by the pitch of neighbours, not across a gap; a pitch that is too small for the badges is none
    texts = ["x40", "×12", "x4O", "xIO", "Xmas", "xl", "(x12)", "x 3", "xBZ", "x0", "x7;", "40", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(badge_quantity(fold_text(F.col("t")))).collect()]
    assert got == [40, 12, 40, 10, None, None, 12, 3, None, None, 7, None, None]


def test_nothing(spark):
    table = spark.createDataFrame([], WORD)
    assert recognised(table, spark.createDataFrame([("Seer",)], "name string")).count() == 0


def test_items_of_tiles(spark):
    tiles = spark.createDataFrame([(1, 1, "Laser", (200, 60, 200)), (1, 2, "laser", (90, 90, 90)), (1, 3, "Seer", None), (1, 4, None, None), (1, 5, "Nobody", None), (1, 6, "Cowboy", (60, 60, 200))], "shot long, place int, name string, bg struct<r:int,g:int,b:int>")
    items = spark.createDataFrame([(10, "Laser", "vintages"), (11, "Laser", "godlies"), (12, "Seer", "rares"), (13, "Cowboy", "rares"), (14, "Cowboy", "rares"), (15, None, "rares")], "item long, name string, category string")
    got = {r.place: (r.item, r.sure, r.candidates) for r in chosen_items(tiles, items).collect()}
    assert got == {1: (11, True, [11, 10]), 2: (11, False, [11, 10]), 3: (12, True, [12]), 4: (None, False, []), 5: (None, False, []), 6: (13, False, [13, 14])}


@pytest.mark.parametrize("cell", [16.0, 64.0])
def test_tiles_in_the_place_of_pictures(spark, cell):
    r = random.Random(2)
    pictures = [(s, k, float(x), float(y), float(x + 50), float(y + 70)) for s in (1, None) for k, (x, y) in enumerate((r.randrange(-60, 200), r.randrange(0, 150)) for _ in range(9))]
    tiles = [(s, k, [(float(r.randrange(-60, 250)), float(r.randrange(0, 220))) for _ in range(r.randrange(4))]) for s in (1, None) for k in range(12)]
    got = {(x.shot, x.place): x.picture for x in same_tiles(spark.createDataFrame(tiles, "shot long, place long, points array<struct<x:double,y:double>>"), spark.createDataFrame(pictures, "shot long, picture long, x0 double, y0 double, x1 double, y1 double"), cell).collect()}
    want, used = {}, set()
    for s, k, points in tiles:
        for p in pictures:
            if p[0] == s and (s, p[1]) not in used and any(p[2] <= x <= p[4] and p[3] <= y <= p[5] for x, y in points):
                want[s, k] = p[1]
                used.add((s, p[1]))
                break
    assert got == want and len(want) > 5


def test_stand_in_is_forty_tiles(spark):
    words, _ = screenshots.stand_in_words(spark, "/root/testdata/sf0.001")
    assert words.groupBy("shot").agg(F.count_distinct(F.floor(F.col("id") / 10)).alias("n")).agg(F.max("n")).first()[0] == 40
