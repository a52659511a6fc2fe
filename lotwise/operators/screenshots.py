"""From words that several passes read on a screenshot to its tiles, and from tiles to items.

Every step is a join, a window or rounds of joins over all screenshots at once. A tile's size is not known beforehand: it
is estimated for each screenshot from how far names and badges are apart, and is a column of the joins that follow.
Windows and lists go over the words of a line, a phrase or a place of one screenshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import banner_category
from ..functions.text import name_key, squeezed
from . import fields
from .common import reread, scratch, table
from .matching import greedy_pairs
from .passes import place_clusters, split_glued
from .products import LEAST, read_names
from .tiles import runs_of_words

QUERIES: dict = {}
ORACLES: dict = {}

#: Fixed values, in widths of a tile: of the badge's right edge from the name's centre and of the name's centre below the badge's (least, usual, most), top and bottom
#: of a tile from the name's centre, width of a tile for each pitch, height of a badge and height of a name.
ACROSS, BELOW, TOP, BOTTOM, BY_PITCH, BY_BADGE, BY_NAME = (0.15, 0.45, 0.80), (0.70, 1.06, 1.45), 1.21, 0.10, 0.935, 8.1, 7.0
#: A phrase wider than this many tiles is two names; pitches beyond this many times the least have a gap; a tile is this many badges high at least; two tiles that
#: have more of their union in common are one; gap between a sign of times and its number in heights; pixels that are the border; a name that needs no banner.
WIDE, CLOSE, SANE, TWIN, SIGN_GAP, BORDER, SURE, LONG = 1.02, 1.5, 4, 0.6, 0.6, 2, 0.95, 5
#: Passes in the order in which they are trusted; categories in the order in which they are traded.
PASSES = ("white", "grayinv", "whitehi", "color")
TRADED = ("godlies", "ancients", "chromas", "uniques", "legendaries", "rares", "uncommons", "commons", "vintages", "pets", "sets")
#: Columns of words (``pass`` and ``line`` say which belong together, r, g, b is the colour behind one) and of tiles.
WORD = "shot long, pass string, line string, id long, text string, x double, y double, w double, h double, cut boolean, r int, g int, b int"


def fold_text(text: Column) -> Column:
    """Text as read from a picture in plain Latin: look-alike letters of other alphabets, one blank between words."""
    return squeezed(F.translate(text, *fields.LOOK_ALIKES))


def badge_quantity(text: Column) -> Column:
    """The number of a quantity badge, letters read for digits put right; null for other texts, and beyond 1 to 9999."""
    raw = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), f"^{fields._signs(fields.BEFORE)}?{fields._CORE}{fields._signs(fields.AFTER)}?$", 1)
    number = raw.rlike("[0-9]") | (raw.rlike(f"^[{fields.FOR_DIGITS[:9]}]+$") & ~raw.isin(*fields.ALONE))
    value = F.when((raw != "") & number, F.translate(raw, fields.FOR_DIGITS, fields.DIGITS).try_cast("int"))
    return F.when(value.between(1, 9999), value)


def _rank(name: Column) -> Column:
    out = F.lit(len(PASSES))
    for k, p in enumerate(PASSES):
        out = F.when(F.substring_index(name, "@", 1) == p, k).otherwise(out)
    return out


def _box(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """The union of boxes, and other aggregates."""
    out = rows.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), *more)
    return out.withColumns({"w": F.col("_r") - F.col("x"), "h": F.col("_b") - F.col("y")}).drop("_r", "_b")


def _numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("shot").orderBy(*order)).cast("long"))


def phrases(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, badges) of words (WORD): badges with their quantity, and runs of other words as phrases with their words, from left to right.

    Words without text or size are left out, and so are those without a letter or digit. A sign of times and a number
    close behind it are one badge. A phrase has two letters, or three letters and digits.
    """
    line = ["shot", "pass", "line"]
    told = words.withColumns({"text": fold_text(F.col("text")), "cut": F.coalesce("cut", F.lit(False)), "pass": F.coalesce("pass", F.lit("")), "line": F.coalesce("line", F.lit(""))}).where("w > 0 and h > 0 and text <> ''")
    row = Window.partitionBy(*line).orderBy("x", "id")
    after = {c: F.lead(c).over(row) for c in ("text", "x", "y", "w", "h", "cut")}
    joins = F.col("text").isin("x", "X", "*") & after["text"].rlike("^[0-9]{1,4}$") & (after["x"] - F.col("x") - F.col("w") <= SIGN_GAP * F.greatest("h", after["h"]))
    told = told.withColumns({f"_{c}": v for c, v in after.items()} | {"_joins": F.coalesce(joins, F.lit(False))})
    told = told.withColumn("_gone", F.coalesce(F.lag("_joins").over(row), F.lit(False))).where("not _gone")
    pick = lambda both, own: F.when(F.col("_joins"), both).otherwise(own)
    low, far = (lambda c: F.least(c, f"_{c}")), (lambda c, s: F.greatest(F.col(c) + F.col(s), F.col(f"_{c}") + F.col(f"_{s}")))
    told = told.withColumns({
        "text": pick(F.concat(F.lit("x"), "_text"), F.col("text")), "x": pick(low("x"), F.col("x")), "y": pick(low("y"), F.col("y")),
        "w": pick(far("x", "w") - low("x"), F.col("w")), "h": pick(far("y", "h") - low("y"), F.col("h")), "cut": F.col("cut") | (F.col("_joins") & F.coalesce("_cut", F.lit(False))),
    }).withColumn("qty", badge_quantity(F.col("text")))
    columns = ["shot", "pass", "line", "id", "text", "x", "y", "w", "h", "cut", "r", "g", "b", "qty"]
    told = told.select(*columns)
    badges = told.where("qty is not null").drop("line")
    runs = runs_of_words(told.where(F.col("qty").isNull() & F.col("text").rlike("[A-Za-z0-9]")).drop("qty"), line)
    parts = runs.groupBy("shot", "pass", "line", "run").agg(F.array_sort(F.collect_list(F.struct("x", "id", "y", "w", "h", "text", "cut", "r", "g", "b"))).alias("words"))
    plain = F.array_join(F.transform("words", lambda v: v["text"]), "")
    names = parts.where((F.length(F.regexp_replace(plain, r"[^\p{L}]", "")) >= 2) | (F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")) >= 3))
    return names, badges


def _whole(rows: DataFrame) -> DataFrame:
    """Boxes of a place (shot, cluster) with ``passes``, how many there are; those that are cut only where all are."""
    place = Window.partitionBy("shot", "cluster")
    return rows.withColumns({"passes": F.count("*").over(place), "_any": F.max(~F.col("cut")).over(place)}).where("not _any or not cut").drop("_any")


def _placed(rows: DataFrame, path: str) -> DataFrame:
    clusters, _ = place_clusters(rows.select("shot", "n", "x", "y", "w", "h"), path)
    return rows.join(clusters.select(F.col("shot").alias("_s"), F.col("n").alias("_n"), "cluster"), F.col("shot").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n"))).drop("_s", "_n")


def merged_badges(badges: DataFrame, path: str) -> DataFrame:
    """One badge (shot, n, qty, votes, passes and box) for each place: the quantity that most boxes say, then one that is written plainly, then the pass that is trusted most."""
    whole = _whole(_placed(_numbered(badges, "cut", F.desc("w"), _rank(F.col("pass")), "id"), path))
    votes = whole.withColumn("votes", F.count("*").over(Window.partitionBy("shot", "cluster", "qty")))
    order = F.struct(-F.col("votes"), ~F.col("text").rlike("^x[0-9]+$"), _rank(F.col("pass")), "n")
    best = votes.groupBy("shot", "cluster").agg(F.min_by(F.struct("qty", "votes", "passes"), order).alias("best"))
    met = votes.withColumnRenamed("qty", "_q").join(best.select(F.col("shot").alias("_s"), F.col("cluster").alias("_c"), "best"), F.col("shot").eqNullSafe(F.col("_s")) & (F.col("cluster") == F.col("_c"))).where(F.col("_q") == F.col("best.qty"))
    return _box(met, ["shot", "cluster", "best"]).select("shot", F.col("cluster").alias("n"), "best.qty", "best.votes", "best.passes", "x", "y", "w", "h")


def _rows_of(boxes: DataFrame, by: list[str], key: Column, order: str = "n") -> DataFrame:
    """Boxes with ``row``: one joins the row of the box before it by the distance of their keys, up to half of the larger height."""
    w = Window.partitionBy(*by).orderBy("_key", order)
    told = boxes.withColumn("_key", key)
    begins = (F.col("_key") - F.lag("_key").over(w) > 0.5 * F.greatest("h", F.lag("h").over(w))) | F.lag("_key").over(w).isNull()
    return told.withColumn("_new", begins.cast("long")).withColumn("row", F.sum("_new").over(w)).drop("_new", "_key")


def tile_widths(names: DataFrame | None, badges: DataFrame) -> DataFrame:
    """(shot, width): the width of a screenshot's tiles by the pitch of its rows, else by the height of badges, else of names."""
    marks = badges.select("shot", F.lit("badge").alias("kind"), "n", F.col("y").alias("key"), (F.col("x") + F.col("w")).alias("pos"), "h")
    if names is not None:
        marks = marks.unionByName(names.select("shot", F.lit("name").alias("kind"), "n", (F.col("y") + F.col("h") / 2).alias("key"), (F.col("x") + F.col("w") / 2).alias("pos"), "h"))
    rows = _rows_of(marks, ["shot", "kind"], F.col("key"))
    pitch = F.col("pos") - F.lag("pos").over(Window.partitionBy("shot", "kind", "row").orderBy("pos", "n"))
    told = rows.withColumn("pitch", pitch).withColumn("least", F.min(F.when(F.col("pitch") > 0, F.col("pitch"))).over(Window.partitionBy("shot")))
    high = lambda kind: F.median(F.when((F.col("kind") == kind) & (F.col("h") > 0), F.col("h")))
    one = told.groupBy("shot").agg((F.median(F.when((F.col("pitch") > 0) & (F.col("pitch") <= CLOSE * F.col("least")), F.col("pitch"))) * BY_PITCH).alias("by"), high("badge").alias("badge"), high("name").alias("name"))
    width = F.when(F.col("by").isNotNull() & (F.col("badge").isNull() | (F.col("by") >= SANE * F.col("badge"))), F.col("by")).when(F.col("badge").isNotNull(), F.col("badge") * BY_BADGE).otherwise(F.col("name") * BY_NAME)
    return one.select("shot", width.alias("width")).where("width is not null")


def _with_width(rows: DataFrame, widths: DataFrame) -> DataFrame:
    return rows.join(widths.select(F.col("shot").alias("_s"), "width").hint("merge"), F.col("shot").eqNullSafe(F.col("_s")), "left").drop("_s")


def split_wide(names: DataFrame) -> DataFrame:
    """Phrases with ``part``: those wider than a tile (column width, null: none) are cut at their widest gap, the last of equal ones, and their parts again."""
    right = lambda v: v["x"] + v["w"]

    def cut(seg: Column, width: Column) -> Column:
        wide = F.array_max(F.transform(seg, right)) - F.array_min(F.transform(seg, lambda v: v["x"])) > WIDE * width
        gaps = F.transform(F.sequence(F.lit(1), F.size(seg) - 1), lambda i: F.struct((F.get(seg, i)["x"] - right(F.get(seg, i - 1))).alias("gap"), i.alias("i")))
        at = F.array_max(gaps)["i"]
        return F.when((F.size(seg) > 1) & F.coalesce(wide, F.lit(False)), F.array(F.slice(seg, F.lit(1), at), F.slice(seg, at + 1, F.size(seg)))).otherwise(F.array(seg))

    parts = F.aggregate(F.sequence(F.lit(1), F.size("words")), F.array(F.col("words")), lambda acc, _: F.flatten(F.transform(acc, lambda seg: cut(seg, F.col("width")))))
    return names.select("shot", "pass", "line", "run", F.posexplode(parts).alias("part", "words"))


def split_names(names: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Phrases (shot, n, pass, text, cut, r, g, b and box) after names that are glued together are split; ``known`` has the keys of names."""
    key = F.to_json(F.struct("shot", "pass", "line", "run", "part"), {"ignoreNullFields": "false"})
    told = names.withColumn("phrase", key)
    told.write.parquet(f"{path}/phrases")
    told = reread(told, f"{path}/phrases")
    split = split_glued(told.select("phrase", F.transform("words", lambda v: v["text"]).alias("words")), known, f"{path}/glued").select(F.col("phrase").alias("_p"), "start", F.col("words").alias("size"))
    parts = told.join(split, F.col("phrase") == F.col("_p")).select("shot", "pass", "phrase", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("size"))).alias("k", "v"))
    rows = parts.select("shot", "pass", "phrase", "start", "k", "v.*")
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda v: v["text"]), " ")
    one = _box(rows, ["shot", "pass", "phrase", "start"], F.max("cut").alias("cut"), text.alias("text"), F.max_by(F.struct("r", "g", "b"), F.struct(spread, -F.col("k"))).alias("bg"))
    return _numbered(one, "cut", F.desc("w"), _rank(F.col("pass")), "phrase", "start").select("shot", "n", "pass", "text", "cut", "bg", "x", "y", "w", "h")


def merged_names(parts: DataFrame, names: DataFrame, path: str) -> DataFrame:
    """One name (shot, n, name, score, text, bg, passes, box) for each place: the name that most phrases say, then the best score, then the pass that is trusted most.

    Places without a name stay if two phrases or more have a text of three letters or digits there.
    """
    key = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")
    told = _whole(_placed(parts, path)).withColumn("key", key)
    found = read_names(told.select(F.col("key").alias("asked")), names.select(F.col("key").alias("name")))
    shown = names.groupBy(F.col("key").alias("_k")).agg(F.min("name").alias("shown"))
    found = found.join(shown, F.col("name") == F.col("_k")).select("asked", F.col("shown").alias("name"), "score")
    told = told.join(found, F.col("key") == F.col("asked"), "left")
    votes = told.withColumn("votes", F.when(F.col("name").isNotNull(), F.count("*").over(Window.partitionBy("shot", "cluster", "name"))).otherwise(0))
    order = F.struct(F.col("name").isNull(), -F.col("votes"), -F.coalesce("score", F.lit(0.0)), _rank(F.col("pass")), "n")
    best = votes.groupBy("shot", F.col("cluster").alias("n")).agg(F.min_by(F.struct("name", "score", "text", "key", "bg", "passes", "x", "y", "w", "h"), order).alias("v")).select("shot", "n", "v.*")
    return best.where((F.col("name").isNotNull() & (F.col("score") >= LEAST)) | ((F.col("passes") >= 2) & (F.length("key") >= 3)))


def associated(names: DataFrame, badges: DataFrame) -> DataFrame:
    """(shot, name_n, badge_n): names with the badge of their own tile, above to the right, the best pairs first; both with their column ``width``.

    Names look for badges in the cells of a grid as wide as a tile, which the window covers: four at most.
    """
    centre = names.select("shot", F.col("n").alias("i"), "width", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")).where("width > 0")
    corner = badges.select(F.col("shot").alias("_s"), F.col("n").alias("j"), (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h") / 2).alias("by"), F.col("width").alias("_w")).where("_w > 0")
    cell = lambda c, w: F.floor(c / w)
    span = lambda c, a, b: F.explode(F.sequence(cell(c + a * F.col("width"), F.col("width")), cell(c + b * F.col("width"), F.col("width"))))
    look = centre.withColumn("gx", span(F.col("cx"), ACROSS[0], ACROSS[2])).withColumn("gy", span(F.col("cy"), -BELOW[2], -BELOW[0]))
    home = corner.withColumns({"hx": cell(F.col("right"), F.col("_w")), "hy": cell(F.col("by"), F.col("_w"))})
    met = look.join(home, F.col("shot").eqNullSafe(F.col("_s")) & (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy")))
    dx, dy = (F.col("right") - F.col("cx")) / F.col("width"), (F.col("cy") - F.col("by")) / F.col("width")
    near = met.where(dx.between(ACROSS[0], ACROSS[2]) & dy.between(BELOW[0], BELOW[2]))
    pairs = near.select(F.col("shot").alias("g"), "i", "j", (F.pow(dx - ACROSS[1], F.lit(2)) + F.pow(dy - BELOW[1], F.lit(2))).alias("fit"))
    return greedy_pairs(pairs, keep_group=True).select(F.col("g").alias("shot"), F.col("i").alias("name_n"), F.col("j").alias("badge_n"))


def recognised(words: DataFrame, names: DataFrame, shots: DataFrame | None = None) -> DataFrame:
    """Tiles of screenshots from the words (WORD) that passes read: shot, place (from top to bottom and left to right), name, text, score, qty, qty_from_badge, x, y, w, h, bg, clipped, qty_uncertain.

    ``names`` (name) are the known ones, ``shots`` (shot, width, height) the sizes of the screenshots. A tile is a name, a
    badge, or both; a name without a badge needs a banner's colour or has to be sure, and one at the border that has no
    badge is left to the screenshot that shows it whole. A name that the border cuts is none. Tiles that cover each
    other are one: the better name, the quantity of a badge. Without names, badges or words there are no tiles; a null
    shot is a shot, and an empty table gives an empty one.
    """
    spark = words.sparkSession
    path = scratch(spark, "tiles")

    def step(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return reread(df, f"{path}/{name}")

    known = names.select("name", F.regexp_replace(F.lower(squeezed(F.col("name"))), "[^a-z0-9]+", "").alias("key")).where("length(key) >= 2").distinct()
    known.write.parquet(f"{path}/names")
    known = spark.read.schema(known.schema).parquet(f"{path}/names")  # a dictionary
    raw, badges = phrases(words)
    badges = step(merged_badges(step(badges, "badge-words"), f"{path}/badge-places"), "badges")
    wide = split_wide(_with_width(raw, tile_widths(None, badges)))
    parts = step(split_names(wide, known.select(F.col("key").alias("name")).distinct(), f"{path}/split"), "parts")
    found = step(merged_names(parts, known, f"{path}/name-places"), "found")
    # by names and badges; where no name is known by badges alone
    own = tile_widths(found.where("name is not null"), badges).select("shot", F.lit(0).alias("p"), "width").unionByName(tile_widths(None, badges).select("shot", F.lit(1).alias("p"), "width"))
    widths = step(own.groupBy("shot").agg(F.min_by("width", "p").alias("width")), "widths")
    found, badges = _with_width(found, widths), _with_width(badges, widths)
    pairs = step(associated(found, badges), "pairs")
    side = lambda rows, prefix: rows.select(F.struct(*rows.columns).alias(prefix), F.col("shot").alias(f"_{prefix}_s"), F.col("n").alias(f"_{prefix}_n"))
    same = lambda prefix: F.col("shot").eqNullSafe(F.col(f"_{prefix}_s")) & (F.col(f"{prefix}_n") == F.col(f"_{prefix}_n"))
    both = pairs.join(side(found, "name"), same("name")).join(side(badges, "badge"), same("badge")).select("shot", "name", "badge", F.lit(0).alias("kind"))
    free = lambda rows, prefix: rows.join(pairs.select(F.col("shot").alias("_s"), F.col(f"{prefix}_n").alias("_n")), F.col("shot").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n")), "left_anti")
    alone = free(found, "name").select("shot", F.struct(*found.columns).alias("name"), F.lit(None).cast(badges.select(F.struct(*badges.columns)).schema[0].dataType).alias("badge"), F.lit(1).alias("kind"))
    bare = free(badges.where("width is not null"), "badge").select("shot", F.lit(None).cast(found.select(F.struct(*found.columns)).schema[0].dataType).alias("name"), F.struct(*badges.columns).alias("badge"), F.lit(2).alias("kind"))
    return _ordered(_merged(_tiles(both.unionByName(alone).unionByName(bare), shots), f"{path}/twins"))


def _tiles(pairs: DataFrame, shots: DataFrame | None) -> DataFrame:
    size = (shots if shots is not None else pairs.sparkSession.createDataFrame([], "shot long, width int, height int")).select(F.col("shot").alias("_s"), F.col("width").alias("img_w"), F.col("height").alias("img_h"))
    rows = pairs.join(size, F.col("shot").eqNullSafe(F.col("_s")), "left").drop("_s")
    n, b = (lambda c: F.col(f"name.{c}")), (lambda c: F.col(f"badge.{c}"))
    has_name, has_badge = F.col("name").isNotNull(), F.col("badge").isNotNull()
    width = F.coalesce(n("width"), b("width"))
    cx = F.when(has_name, n("x") + n("w") / 2).otherwise(b("x") + b("w") - ACROSS[1] * width)
    cy = F.when(has_name, n("y") + n("h") / 2).otherwise(b("y") + b("h") / 2 + BELOW[1] * width)
    known = F.col("img_w").isNotNull() & F.col("img_h").isNotNull()
    touches = lambda o: F.coalesce(known & ((o("x") <= BORDER) | (o("y") <= BORDER) | (o("x") + o("w") >= F.col("img_w") - BORDER) | (o("y") + o("h") >= F.col("img_h") - BORDER)), F.lit(False))
    box = {"x": F.bround(cx - width / 2, 0), "y": F.bround(cy - TOP * width, 0), "w": F.bround(width, 0), "h": F.bround((TOP + BOTTOM) * width, 0)}
    rows = rows.withColumns({f"_{c}": v for c, v in box.items()} | {"_width": width})
    outside = F.coalesce((F.col("_x") < -0.1 * width) | (F.col("_x") + F.col("_w") > F.col("img_w") + 0.1 * width), F.lit(False))
    clipped = touches(n) | outside
    name = F.when(~clipped, n("name"))
    bg = n("bg")
    banner = bg.isNull() | bg["r"].isNull() | (F.greatest(bg["r"], bg["g"], bg["b"]) - F.least(bg["r"], bg["g"], bg["b"]) >= 50) | (F.greatest(bg["r"], bg["g"], bg["b"]) >= 140)
    told = has_badge | (~clipped & name.isNotNull() & (banner | ((n("score") >= SURE) & (F.length(name_key(name)) >= LONG))))
    return rows.where(told).select(
        "shot", "kind", F.coalesce(n("n"), F.lit(0)).alias("i"), F.coalesce(b("n"), F.lit(0)).alias("j"), name.alias("name"), F.coalesce(n("text"), F.lit("")).alias("text"), F.coalesce(n("score"), F.lit(0.0)).alias("score"),
        F.coalesce(b("qty"), F.lit(1)).alias("qty"), has_badge.alias("qty_from_badge"), *[F.coalesce(f"_{c}", n(c)).alias(c) for c in "xywh"], bg.alias("bg"), (clipped | touches(b)).alias("clipped"),
        F.coalesce(~has_badge & (F.col("_y") < -0.05 * F.col("_width")), F.lit(False)).alias("qty_uncertain"), F.col("_x").isNotNull().alias("_boxed"),
    )


def _covers(a: dict[str, Column], b: dict[str, Column]) -> Column:
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    shared = F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))
    return shared > TWIN * (a["w"] * a["h"] + b["w"] * b["h"] - shared)


def _merged(tiles: DataFrame, path: str) -> DataFrame:
    """One tile for each place."""
    tiles = _numbered(tiles, "kind", "i", "j")
    tiles.write.parquet(f"{path}/tiles")
    tiles = reread(tiles, f"{path}/tiles")
    places, _ = place_clusters(tiles.select("shot", "n", *[F.when(F.col("_boxed"), F.col(c)).alias(c) for c in "xywh"]), f"{path}/places", _covers)
    met = tiles.join(places.select(F.col("shot").alias("_s"), F.col("n").alias("_n"), "cluster"), F.col("shot").eqNullSafe(F.col("_s")) & (F.col("n") == F.col("_n")))
    best = F.min_by(F.struct("name", "text", "score", "x", "y", "w", "h", "bg", "clipped"), F.struct(F.col("name").isNull(), -F.col("score"), "n"))
    counted = F.max_by(F.struct("qty", "qty_from_badge"), F.struct("qty_from_badge", "qty"))
    return met.groupBy("shot", F.col("cluster").alias("n")).agg(best.alias("v"), counted.alias("q"), F.min("qty_uncertain").alias("qty_uncertain")).select("shot", "n", "v.*", "q.*", "qty_uncertain")


def _ordered(tiles: DataFrame) -> DataFrame:
    rows = _rows_of(tiles, ["shot"], F.col("y") + F.col("h"))
    place = F.row_number().over(Window.partitionBy("shot").orderBy("row", "x", "n"))
    return rows.select("shot", place.alias("place"), "name", "text", "score", "qty", "qty_from_badge", "x", "y", "w", "h", "bg", "clipped", "qty_uncertain")


def chosen_items(tiles: DataFrame, items: DataFrame) -> DataFrame:
    """Tiles (shot, place, name, bg) with item, sure and candidates among items (item, name, category) of their name.

    One candidate is sure; of several the only one of the banner's category is, else the one of the category that is
    traded most, then the smallest item, is taken and is not. A tile without a known name has none.
    """
    rank = F.lit(len(TRADED))
    for k, c in enumerate(TRADED):
        rank = F.when(F.col("category") == c, k).otherwise(rank)
    by = items.where("name is not null").groupBy(name_key(F.col("name")).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "item", "category"))).alias("all"))  # items of one name
    told = tiles.join(by, name_key(F.col("name")) == F.col("_key"), "left").drop("_key")
    fits = F.filter("all", lambda c: F.coalesce(c["category"] == banner_category(F.col("bg.r"), F.col("bg.g"), F.col("bg.b")), F.lit(False)))
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when(F.size(fits) == 1, F.get(fits, F.lit(0)))
    none = F.array().cast("array<bigint>")
    return told.withColumns({"_one": one}).select(*tiles.columns, F.coalesce(F.col("_one.item"), F.get("all", F.lit(0))["item"]).alias("item"), F.col("_one").isNotNull().alias("sure"), F.coalesce(F.transform("all", lambda c: c["item"].cast("long")), none).alias("candidates"))


def same_tiles(tiles: DataFrame, pictures: DataFrame, cell: float = 64.0) -> DataFrame:
    """(shot, place, picture): tiles that were read with the tile that was seen in their place, each once: in the order of
    ``place`` and ``picture`` the first that is free and holds a centre of the tile (array ``points`` of x and y).

    Pictures are shot, picture, x0, y0, x1, y1; they lie in the cells of a grid in which the points look for them.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    home = pictures.where("x1 >= x0 and y1 >= y0").select(F.col("shot").alias("_s"), F.col("picture").alias("j"), "x0", "y0", "x1", "y1").withColumn("hx", span("x0", "x1")).withColumn("hy", span("y0", "y1"))
    look = tiles.select("shot", F.col("place").alias("i"), F.explode("points").alias("p")).select("shot", "i", "p.x", "p.y").where("x is not null and y is not null")
    met = look.join(home, F.col("shot").eqNullSafe(F.col("_s")) & (F.floor(F.col("x") / cell) == F.col("hx")) & (F.floor(F.col("y") / cell) == F.col("hy"))).where("x between x0 and x1 and y between y0 and y1")
    pairs = met.select(F.col("shot").alias("g"), "i", "j", F.lit(0.0).alias("fit"))
    return greedy_pairs(pairs, keep_group=True).select(F.col("g").alias("shot"), F.col("i").alias("place"), F.col("j").alias("picture"))


def stand_in_words(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, names): screenshots of forty tiles, five rows of eight, that four passes read; a tile is a part, its name below and its badge at the corner."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 40
    passes = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.lit(j).alias("j")) for j, p in enumerate(PASSES)])).alias("p")
    left, top = (k % 8) * 130 + 20, F.floor(k / 8) * 190 + 20
    base = part.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("shot"), F.col("p_partkey").alias("key"), "p_name", (F.col("p_size") % 9 + 1).alias("qty"), left.alias("left"), top.alias("top"), k.alias("k"), passes)
    j = F.col("p.j") * 0.4
    word = lambda text, x, y, w, h, n: F.struct(text.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), F.lit(h).cast("double").alias("h"), F.lit(n).alias("n"))
    split = F.split("p_name", " +")
    own = F.transform(split, lambda w, i: word(w, F.col("left") + 60 - F.length("p_name") * 3 + F.coalesce(F.aggregate(F.slice(split, F.lit(1), i), F.lit(0), lambda a, v: a + F.length(v) + 1), F.lit(0)) * 6 + j, F.col("top") + 146, F.length(w) * 6, 15, 1))
    badge = F.when((F.col("qty") > 1) & (F.col("k") % 11 > 0), F.array(word(F.concat(F.lit("x"), F.col("qty")), F.col("left") + 92 + j, F.col("top") + 10, F.length(F.concat(F.lit("x"), F.col("qty"))) * 12, 15, 0)))
    none = F.array().cast("array<struct<text:string,x:double,y:double,w:double,h:double,n:int>>")
    told = base.withColumn("v", F.explode(F.concat(own, F.coalesce(badge, none))))
    words = told.select("shot", "p.pass", F.concat_ws("-", F.floor(F.col("k") / 8), "v.n").alias("line"), (F.col("key") * 10 + F.col("v.n")).alias("id"), "v.text", "v.x", "v.y", "v.w", "v.h", F.lit(False).alias("cut"), F.lit(180).alias("r"), F.lit(40).alias("g"), F.lit(160).alias("b"))
    return words, part.select(F.col("p_name").alias("name")).distinct()


def shot_tiles(spark, sf_dir: str) -> DataFrame:
    """Tiles of all screenshots: place, name, quantity and whether a badge said it."""
    words, names = stand_in_words(spark, sf_dir)
    return recognised(words, names).select("shot", "place", "name", "qty", "qty_from_badge")


QUERIES["shot_tiles"] = shot_tiles
# what the stand-in shows, not how it is read
ORACLES["shot_tiles"] = """
SELECT p_partkey // 40 AS shot, (row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey % 40))::INTEGER AS place, p_name AS name, CASE WHEN badge THEN p_size % 9 + 1 ELSE 1 END AS qty, badge AS qty_from_badge
FROM (SELECT *, p_size % 9 > 0 AND p_partkey % 40 % 11 > 0 AS badge FROM part) p"""
