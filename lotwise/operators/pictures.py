"""Pictures as rows: blobs of a mask, framed tiles, features of what a picture shows, how alike two are, and features as short texts.

A picture is id, width, height and pixels: four bytes (red, green, blue, cover) for each of width x height pixels, row by
row. A picture is one value; pictures are dealt to tasks as rows, and what a task does to one is arithmetic on arrays.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

QUERIES: dict = {}
ORACLES: dict = {}

#: Cells of a feature's grid in each direction; bins of its histogram, twelve hues and four greys; the game's background; the colour
#: difference at which a cell is about 0.6 alike, and the cover that a cell needs for its colour to count; shares of shape, colour, place and histogram.
GRID, HUES, GREYS, BACKGROUND = 20, 12, 4, 54
SIGMA, COVERED, SHAPE, PLACE = 0.11, 0.05, 0.45, 0.8
#: Grey if the colour is weaker than this; a pixel shows by its difference from the background and by its colour beyond these, fully 12 later.
GREY, SEEN, COLOURED, FULL = 0.035, 7, 9, 12
#: Fixed values of a tile's banner: least width and height, their ratio, share of its box, of its first and last rows and columns, of frames and of the icon's sides.
LEAST_WIDTH, LEAST_HEIGHT, RATIO, FILLED, ROWS, SIDES, FRAME, BESIDE = 16, 5, (2.4, 8.0), 0.5, 0.85, 0.8, 0.8, 0.5
BINS = HUES + GREYS
PACKED = GRID * GRID * 4 + BINS + 1


# -- connected components ---------------------------------------------------------------------------------------------


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """x0, y0, x1, y1 and count of each connected area of a mask, in the order of its first pixel; ``corners`` join as well.

    Rows are cut into runs; runs of neighbouring rows that touch are joined by hooking each to the smallest that it
    touches, over and over, until nothing changes.
    """
    labels, (row, first, last) = run_labels(mask, corners)
    roots, own = np.unique(labels, return_inverse=True)
    out = np.zeros((len(roots), 5), np.int64)
    if len(roots):
        for k, (how, values) in enumerate(((np.minimum, first), (np.minimum, row), (np.maximum, last), (np.maximum, row))):
            out[:, k] = values.max() if how is np.minimum else -1
            how.at(out[:, k], own, values)
        out[:, 4] = np.bincount(own, weights=last - first + 1).astype(np.int64)
    return out


def run_labels(mask: np.ndarray, corners: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of a mask's rows the number of the first run of its area; and row, first and last column of the runs."""
    height, width = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    # runs in reading order have places that grow with row and column: those of the row above that a run touches are a range
    wide, reach = width + 2, 1 if corners else 0
    a = np.searchsorted(row * wide + last, (row - 1) * wide + first - reach)
    b = np.searchsorted(row * wide + first, (row - 1) * wide + last + reach, "right")
    count = np.maximum(b - a, 0)
    low = np.repeat(np.arange(len(row)), count)
    up = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(len(row))
    while True:
        least = np.minimum(root[low], root[up])
        new = root.copy()
        for at in (root[low], root[up], low, up):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            return root, (row, first, last)
        root = new


def banner(rgb: np.ndarray) -> np.ndarray:
    """Pixels that can be of a tile's banner: coloured, or light."""
    most, least = rgb.max(axis=2), rgb.min(axis=2)
    return ((most >= 70) & (most - least >= 0.35 * most)) | (least >= 0x58)


class Shares:
    """Shares of the pixels of a mask in rectangles, by sums over all pixels before each."""

    def __init__(self, mask: np.ndarray):
        self.height, self.width = mask.shape
        self.sums = np.pad(mask.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

    def __call__(self, x0: int, y0: int, x1: int, y1: int) -> float:
        """0 where the rectangle is empty or begins outside the picture."""
        if x1 < x0 or y1 < y0 or x0 < 0 or y0 < 0 or x1 >= self.width or y1 >= self.height:
            return 0.0
        s = self.sums
        return float(s[y1 + 1, x1 + 1] - s[y0, x1 + 1] - s[y1 + 1, x0] + s[y0, x0]) / ((x1 - x0 + 1) * (y1 - y0 + 1))


def framed_tiles(rgb: np.ndarray) -> list[tuple]:
    """Tiles of an inventory: x0, x1, top and bottom of the icon, y0 and y1 of the banner, and whether the picture cuts the tile off.

    A banner is a coloured area with straight edges in a dark frame (or at the border of the picture), below a dark line;
    the icon is above that line up to the next one, on a grey ground. Tiles have one width: others than the median go.
    """
    rgb = rgb.astype(int)
    height, width = rgb.shape[:2]
    shown = banner(rgb)
    most, least = rgb.max(axis=2), rgb.min(axis=2)
    solid, dark, ground = Shares(shown), Shares(most <= 45), Shares((most - least <= 10) & (rgb[:, :, 0] >= 0x22) & (rgb[:, :, 0] <= 0x50))
    found = []
    for x0, y0, x1, y1, count in components(shown).tolist():
        w, h = x1 - x0 + 1, y1 - y0 + 1
        if w < LEAST_WIDTH or h < LEAST_HEIGHT or not RATIO[0] <= w / h <= RATIO[1] or count < FILLED * w * h:
            continue
        rows = [max(solid(x0, y, x1, y) for y in two) for two in ((y0, y0 + 1), (y1, y1 - 1))]
        sides = [max(solid(x, y0, x, y1) for x in two) for two in ((x0, x0 + 1), (x1, x1 - 1))]
        if min(rows) < ROWS or min(sides) < SIDES:
            continue
        near = range(1, max(2, int(h * 0.2 + 0.5)) + 1)
        line = lambda y: dark(x0, y, x1, y) >= FRAME  # noqa: B023, E731
        framed = (x0 <= 1 or any(dark(x0 - k, y0, x0 - k, y1) >= FRAME for k in near)) and (x1 >= width - 2 or any(dark(x1 + k, y0, x1 + k, y1) >= FRAME for k in near)) and (y1 >= height - 2 or any(line(y1 + k) for k in near))
        above = next((y0 - k for k in near if line(y0 - k)), -1)
        if not framed or above < 0:
            continue
        while above > 0 and line(above - 1):
            above -= 1
        bottom = above - 1
        top = next((y + 1 for y in range(bottom - int(w * 0.6 + 0.5), max(0, bottom - int(w * 1.4 + 0.5)) - 1, -1) if line(y)), None)
        cut = top is None and bottom - int(w * 1.05 + 0.5) + 1 < 0
        top = max(0, bottom - int(w * 1.05 + 0.5) + 1) if top is None else top
        inset = max(1, int(w * 0.01 + 0.5))
        if bottom - top < w * 0.4 or max(ground(x0 + inset, top, x0 + inset, bottom), ground(x1 - inset, top, x1 - inset, bottom)) < BESIDE:
            continue
        found.append((x0, x1, top, bottom, y0, y1, cut or x0 <= 1 or x1 >= width - 2 or y1 >= height - 2))
    widths = sorted(x1 - x0 + 1 for x0, x1, *_, cut in found if not cut)
    usual = widths[len(widths) // 2] if widths else None
    fits = lambda t: usual is None or (t[1] - t[0] + 1 <= usual * 1.15 if t[6] else abs(t[1] - t[0] + 1 - usual) <= usual * 0.12)
    return sorted((t for t in found if fits(t)), key=lambda t: (t[4], t[0]))


# -- features ---------------------------------------------------------------------------------------------------------


def oklab(rgb: np.ndarray) -> np.ndarray:
    """sRGB from 0 to 255 to OKLab, by its published matrices."""
    c = np.asarray(rgb, float) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    cone = np.cbrt(linear @ np.array([[0.4122214708, 0.2119034982, 0.0883024619], [0.5363325363, 0.6806995451, 0.2817188376], [0.0514459929, 0.1073969566, 0.6299787005]]))
    return cone @ np.array([[0.2104542553, 1.9779984951, 0.0259040371], [0.7936177850, -2.4285922050, 0.7827717662], [-0.0040720468, 0.4505937099, -0.8086757660]])


def visible(rgb: np.ndarray, ground: int = BACKGROUND) -> np.ndarray:
    """How much of each pixel shows on a grey ground, from 0 to 1."""
    apart = np.abs(rgb - ground).max(axis=-1)
    colour = rgb.max(axis=-1) - rgb.min(axis=-1)
    return np.clip(np.maximum((apart - SEEN) / FULL, (colour - COLOURED) / FULL), 0, 1)


def shown(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colour on the game's ground and weight of the pixels (height, width, 4). Where the picture itself has an opaque ground, that is what its border's colour reaches."""
    cover = pixels[:, :, 3] / 255
    if (pixels[:, :, 3] < 128).sum() < 0.02 * cover.size:
        rim = np.concatenate([np.stack([pixels[0], pixels[-1]], 1).reshape(-1, 4), np.stack([pixels[:, 0], pixels[:, -1]], 1).reshape(-1, 4)])[:, :3]
        usual = np.sort(rim, axis=0)[len(rim) // 2]
        close = np.abs(pixels[:, :, :3].astype(int) - usual.astype(int)).max(axis=2) <= 24
        labels, (row, first, last) = run_labels(close, corners=False)
        outer = np.isin(labels, labels[(row == 0) | (row == len(close) - 1) | (first == 0) | (last == close.shape[1] - 1)])
        ground = np.zeros((close.shape[0], close.shape[1] + 1), int)
        np.add.at(ground, (row[outer], first[outer]), 1)
        np.add.at(ground, (row[outer], last[outer] + 1), -1)
        cover = np.where(ground.cumsum(axis=1)[:, :-1] > 0, 0.0, cover)
    rgb = np.floor(pixels[:, :, :3] * cover[:, :, None] + BACKGROUND * (1 - cover[:, :, None]) + 0.5)
    return rgb, np.where(cover < 0.05, 0.0, visible(rgb))


def _trimmed(sums: np.ndarray, spare: float) -> tuple[int, int]:
    """First and last index once up to ``spare`` is left off at either end."""
    a = min(int(np.searchsorted(sums.cumsum(), spare, "right")), len(sums) - 1)
    b = len(sums) - 1 - min(int(np.searchsorted(sums[::-1].cumsum(), spare, "right")), len(sums) - 1 - a)
    return a, b


def feature(rgb: np.ndarray, weight: np.ndarray) -> dict | None:
    """Cover and mean colour in a grid over the square around what a picture shows, histogram of its colours, and its
    aspect; null if next to nothing shows. One hundredth of the weight at each side is dust."""
    total = weight.sum()
    if total < 4:
        return None
    (x0, x1), (y0, y1) = _trimmed(weight.sum(axis=0), total * 0.01), _trimmed(weight.sum(axis=1), total * 0.01)
    side = max(x1 - x0, y1 - y0) + 1
    cell = side / GRID
    points = min(8, int(cell + 0.5)) if cell >= 3 else 3
    step = (np.arange(GRID * points) + 0.5) / points * cell
    held = np.pad(np.dstack([rgb * weight[:, :, None], weight]), ((1, 1), (1, 1), (0, 0)))

    def ends(start: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = start + step - 0.5
        low = np.floor(at)
        return np.clip(low + 1, 0, size + 1).astype(int), np.clip(low + 2, 0, size + 1).astype(int), at - low

    xa, xb, tx = ends((x0 + x1 + 1 - side) / 2, weight.shape[1])
    ya, yb, ty = ends((y0 + y1 + 1 - side) / 2, weight.shape[0])
    down = held[ya] * (1 - ty)[:, None, None] + held[yb] * ty[:, None, None]
    drawn = down[:, xa] * (1 - tx)[None, :, None] + down[:, xb] * tx[None, :, None]
    sums = drawn.reshape(GRID, points, GRID, points, 4).sum(axis=(1, 3))
    cover = sums[:, :, 3] / points**2
    some = sums[:, :, 3] > 1e-6
    lab = np.zeros((GRID, GRID, 3))
    lab[some] = oklab(np.floor(sums[some][:, :3] / sums[some][:, 3:] + 0.5))
    chroma = np.hypot(lab[:, :, 1], lab[:, :, 2])
    hue = np.floor((np.arctan2(lab[:, :, 2], lab[:, :, 1]) + np.pi) / (2 * np.pi) * HUES).astype(int) % HUES
    bin_ = np.where(chroma < GREY, HUES + np.minimum(GREYS - 1, np.floor(lab[:, :, 0] / 0.25).astype(int)), hue)
    hist = np.bincount(bin_[some], weights=cover[some], minlength=BINS)
    return {"cover": cover, "lab": lab, "hist": hist / (hist.sum() or 1), "aspect": (x1 - x0 + 1) / (y1 - y0 + 1)}


def pack(f: dict | None) -> str | None:
    """A feature as base64 of PACKED bytes."""
    if f is None:
        return None
    byte = lambda v: np.floor(np.asarray(v, float) + 0.5).astype(np.uint8).ravel()
    colour = np.dstack([np.clip(f["lab"][:, :, 0], 0, 1) * 255, np.clip(f["lab"][:, :, 1:], -0.5, 0.5) * 255 + 127.5])
    parts = [byte(np.clip(f["cover"], 0, 1) * 255), byte(np.minimum(colour, 255)), byte(f["hist"] * 255), byte([min(max(f["aspect"], 0.2), 5) * 50])]
    return base64.b64encode(np.concatenate(parts).tobytes()).decode()


def unpack(text: str | None) -> dict | None:
    """The feature of a text; null for null and for what is none."""
    try:
        raw = np.frombuffer(base64.b64decode(text or "", validate=True), np.uint8).astype(float)
    except ValueError:
        return None
    if len(raw) != PACKED:
        return None
    cells = GRID * GRID
    colour = raw[cells : 4 * cells].reshape(GRID, GRID, 3)
    return {"cover": raw[:cells].reshape(GRID, GRID) / 255, "lab": np.dstack([colour[:, :, 0] / 255, (colour[:, :, 1:] - 127.5) / 255]), "hist": raw[4 * cells : -1] / 255, "aspect": raw[-1] / 50}


def likeness(a: dict | None, b: dict | None) -> float:
    """How alike two features are: the best of nine shifts by a cell, shape and colour, and the histograms; 0 without a feature."""
    if a is None or b is None:
        return 0.0
    wide = np.pad(b["cover"], 1), np.pad(b["lab"], ((1, 1), (1, 1), (0, 0)))
    best = -1.0
    for dy in range(3):
        for dx in range(3):
            cover, lab = wide[0][dy : dy + GRID, dx : dx + GRID], wide[1][dy : dy + GRID, dx : dx + GRID]
            both, either = np.minimum(a["cover"], cover), np.maximum(a["cover"], cover).sum()
            w = np.where(both > COVERED, both, 0.0)
            alike = np.exp(-((a["lab"] - lab) ** 2).sum(axis=2) / (2 * SIGMA**2))
            shape, colour = both.sum() / either if either else 0.0, (w * alike).sum() / w.sum() if w.any() else 0.0
            best = max(best, SHAPE * shape + (1 - SHAPE) * colour)
    return round(float(PLACE * best + (1 - PLACE) * np.minimum(a["hist"], b["hist"]).sum()), 4)


# -- as tables --------------------------------------------------------------------------------------------------------


def _pictures(df: DataFrame, made: Callable[[np.ndarray], list[tuple]], columns: str, names: list[str]) -> DataFrame:
    """Rows of ``made(pixels)`` for each picture; pictures that are null or not as large as they say give none."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for k, (w, h, raw) in enumerate(zip(*[b.column(c).to_pylist() for c in (1, 2, 3)], strict=True)):
                if raw is None or not w or not h or len(raw) != 4 * w * h:
                    continue
                new = made(np.frombuffer(raw, np.uint8).reshape(h, w, 4))
                ids += [k] * len(new)
                rows += new
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), *[pa.array(c) for c in zip(*rows, strict=True)]], names=["id", *names])

    return df.select("id", "width", "height", "pixels").mapInArrow(run, f"id {kind}, {columns}")


def picture_blobs(pictures: DataFrame, mask: Callable[[np.ndarray], np.ndarray] = lambda p: banner(p[:, :, :3].astype(int))) -> DataFrame:
    """id, x0, y0, x1, y1, count of each connected area (corners join) of the pixels that ``mask`` takes; see ``_pictures`` for odd rows."""
    names = ["x0", "y0", "x1", "y1", "count"]
    return _pictures(pictures, lambda p: [tuple(r) for r in components(mask(p)).tolist()], ", ".join(f"{n} long" for n in names), names)


def picture_tiles(pictures: DataFrame) -> DataFrame:
    """id and the framed tiles of each picture, from top to bottom and left to right (``place``)."""
    names = ["place", "x0", "x1", "icon_top", "icon_bottom", "banner_top", "banner_bottom", "cut"]
    kinds = ", ".join(f"{n} {'boolean' if n == 'cut' else 'long'}" for n in names)
    return _pictures(pictures, lambda p: [(k, *t) for k, t in enumerate(framed_tiles(p[:, :, :3]))], kinds, names)


def picture_features(pictures: DataFrame) -> DataFrame:
    """id and feature (base64, below 4 096 characters) of each picture; null where next to nothing shows."""
    return _pictures(pictures, lambda p: [(pack(feature(*shown(p))) or "",)], "feature string", ["feature"]).withColumn("feature", F.nullif("feature", F.lit("")))


def feature_likeness(a: Column, b: Column) -> Column:
    """Likeness of two packed features; 0 where one is null or none."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        known = {t: unpack(t) for t in {*x.dropna(), *y.dropna()}}
        return pd.Series([likeness(known.get(s), known.get(t)) for s, t in zip(x, y, strict=True)], dtype=float)

    return of(a, b)


def _stand_ins(spark, sf_dir: str) -> DataFrame:
    """Pictures from embeddings: eight vectors on end are the rows of one, each component a pixel; the vectors' labels colour them."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select((F.floor(F.col("vec_id") / 8)).cast("long").alias("id"), F.col("vec_id").alias("row"), "embedding", F.coalesce("label", F.lit(0)).alias("label"))
    byte = lambda v: F.right(F.hex(v.cast("int")), F.lit(2))
    two = lambda v: F.lpad(byte(v), 2, "0")
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.3) * 420)))
    pixel = lambda x: F.concat(two(level(x)), two(level(-x)), two(F.col("label") * 25 % 256), F.when(x > 0.1, "FF").otherwise("00"))
    rows = e.withColumn("line", F.array_join(F.transform("embedding", pixel), ""))
    one = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))  # eight rows
    return one.select("id", F.lit(64).alias("width"), F.size("lines").alias("height"), F.unhex(F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("pixels"))


def blobs(spark, sf_dir: str) -> DataFrame:
    """Connected areas of the covered pixels of each picture."""
    return picture_blobs(_stand_ins(spark, sf_dir), lambda p: p[:, :, 3] > 0)


QUERIES["picture_blobs"] = blobs
ORACLES["picture_blobs"] = """
WITH RECURSIVE g AS MATERIALIZED (SELECT vec_id // 8 AS id, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS y, embedding AS e FROM embeddings WHERE len(embedding) = 64),
c AS MATERIALIZED (SELECT id, x, y FROM (SELECT id, y, x, e[x + 1] AS v FROM g, range(64) r(x)) q WHERE v::DOUBLE > 0.1),
n AS MATERIALIZED (SELECT a.id, a.x * 8 + a.y AS p, b.x * 8 + b.y AS q FROM c a JOIN c b ON a.id = b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT id, x * 8 + y AS p, x * 8 + y AS q FROM c UNION SELECT r.id, r.p, n.q FROM r JOIN n ON n.id = r.id AND n.p = r.q),
k AS (SELECT id, p, min(q) AS area FROM r GROUP BY ALL)
SELECT id, min(p // 8) AS x0, min(p % 8) AS y0, max(p // 8) AS x1, max(p % 8) AS y1, count(*) AS count FROM k GROUP BY id, area"""


def likenesses(spark, sf_dir: str) -> DataFrame:
    """How alike each picture and the next one are."""
    f = picture_features(_stand_ins(spark, sf_dir))
    pairs = f.join(f.select((F.col("id") - 1).alias("before"), F.col("feature").alias("other")), F.col("id") == F.col("before"))
    return pairs.select("id", F.length("feature").alias("n_chars"), feature_likeness(F.col("feature"), F.col("other")).alias("likeness"))


QUERIES["picture_likeness"] = likenesses
