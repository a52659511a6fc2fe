"""Connected areas against flood fill, features and likeness against loops over pixels and shifts, tiles drawn by hand."""

import math
import random

import numpy as np
import pytest

from lotwise.operators import pictures
from lotwise.operators.pictures import GRID, components, feature, framed_tiles, likeness, oklab, pack, shown, unpack


def flood(mask, corners):
    h, w = mask.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if not mask[y, x] or (x, y) in seen:
                continue
            todo, area = [(x, y)], set()
            while todo:
                p = todo.pop()
                if p in area or not (0 <= p[0] < w and 0 <= p[1] < h) or not mask[p[1], p[0]]:
                    continue
                area.add(p)
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not (i and j)]
            seen |= area
            xs, ys = zip(*area, strict=True)
            out.append((min(xs), min(ys), max(xs), max(ys), len(area)))
    return out


SPIRAL = np.array([[c == "#" for c in row] for row in ["#########", "#       #", "# ##### #", "# #   # #", "# # # # #", "# # ### #", "# #     #", "# #######"]])


@pytest.mark.parametrize("corners", [True, False])
def test_components_equal_flood_fill(corners):
    r = np.random.default_rng(3)
    masks = [r.random((h, w)) < d for h, w in ((1, 1), (1, 30), (30, 1), (17, 23), (40, 40)) for d in (0.2, 0.45, 0.7)]
    masks += [SPIRAL, np.zeros((5, 7), bool), np.ones((6, 4), bool), np.indices((9, 9)).sum(axis=0) % 2 == 0]
    for mask in masks:
        assert [tuple(x) for x in components(mask, corners).tolist()] == flood(mask, corners)


def test_components_of_large_pictures():
    assert components(np.ones((2000, 3000), bool)).tolist() == [[0, 0, 2999, 1999, 6_000_000]]
    board = np.indices((800, 801)).sum(axis=0) % 2 == 0
    assert len(components(board)) == 1 and len(components(board, corners=False)) == board.sum()
    comb = np.zeros((2001, 401), bool)  # a snake: each row but one column joins the next
    comb[::2] = True
    comb[1::4, -1] = comb[3::4, 0] = True
    assert len(components(comb)) == 1


def drawn(width=260, height=200, tiles=((10, 8), (90, 8), (170, 8)), banner=(200, 40, 200)):
    """Tiles of 64 pixels: a dark frame, a grey square with something in it, a dark line, a banner."""
    img = np.full((height, width, 3), 120, np.uint8)
    img[:] = (20, 60, 90)
    for x, y in tiles:
        img[y : y + 90, x : x + 68] = 10
        img[y + 2 : y + 68, x + 2 : x + 66] = 54
        img[y + 20 : y + 50, x + 20 : x + 45] = (180, 30, 30)
        img[y + 70 : y + 88, x + 2 : x + 66] = banner
        img[y + 75 : y + 82, x + 20 : x + 40] = 255
    return img


def test_tiles_of_a_drawing():
    img = drawn()
    assert framed_tiles(img) == [(x + 2, x + 65, 10, 75, 78, 95, False) for x in (10, 90, 170)]
    cut = drawn(tiles=((10, 8), (90, 8), (-30 + 240, 8)))
    assert [t[6] for t in framed_tiles(cut)] == [False, False, True]
    assert framed_tiles(np.zeros((50, 50, 3), np.uint8)) == [] == framed_tiles(np.full((50, 50, 3), 255, np.uint8))
    loose = drawn(banner=(40, 48, 60))  # no banner
    assert framed_tiles(loose) == []
    other = drawn()
    other[78:96, 92:120] = 10  # a banner of another width among three
    assert len(framed_tiles(other)) == 2


def plain_feature(rgb, weight):
    """Pixel by pixel, from the definition."""
    h, w = weight.shape
    total = weight.sum()
    if total < 4:
        return None

    def trim(sums):
        a, b, acc = 0, len(sums) - 1, 0
        while a < b and acc + sums[a] <= total * 0.01:
            acc, a = acc + sums[a], a + 1
        acc = 0
        while b > a and acc + sums[b] <= total * 0.01:
            acc, b = acc + sums[b], b - 1
        return a, b

    (x0, x1), (y0, y1) = trim(weight.sum(axis=0)), trim(weight.sum(axis=1))
    side = max(x1 - x0 + 1, y1 - y0 + 1)
    sx, sy, cell = (x0 + x1 + 1) / 2 - side / 2, (y0 + y1 + 1) / 2 - side / 2, side / GRID
    n = min(8, math.floor(cell + 0.5)) if cell >= 3 else 3
    cover, lab, hist = np.zeros((GRID, GRID)), np.zeros((GRID, GRID, 3)), [0.0] * 16
    for gy in range(GRID):
        for gx in range(GRID):
            s = np.zeros(4)
            for j in range(n):
                for i in range(n):
                    fx, fy = sx + (gx + (i + 0.5) / n) * cell - 0.5, sy + (gy + (j + 0.5) / n) * cell - 0.5
                    x, y = math.floor(fx), math.floor(fy)
                    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
                        k = (fx - x if dx else 1 - fx + x) * (fy - y if dy else 1 - fy + y)
                        if 0 <= x + dx < w and 0 <= y + dy < h:
                            v = weight[y + dy, x + dx] * k
                            s += [*(rgb[y + dy, x + dx] * v), v]
            cover[gy, gx] = s[3] / n**2
            if s[3] > 1e-6:
                lab[gy, gx] = oklab(np.floor(s[:3] / s[3] + 0.5))
                c = math.hypot(lab[gy, gx, 1], lab[gy, gx, 2])
                k = 12 + min(3, math.floor(lab[gy, gx, 0] / 0.25)) if c < 0.035 else math.floor((math.atan2(lab[gy, gx, 2], lab[gy, gx, 1]) + math.pi) / (2 * math.pi) * 12) % 12
                hist[k] += cover[gy, gx]
    return {"cover": cover, "lab": lab, "hist": np.array(hist) / (sum(hist) or 1), "aspect": (x1 - x0 + 1) / (y1 - y0 + 1)}


def plain_likeness(a, b):
    best = -1
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            inter = union = cs = cw = 0.0
            for y in range(GRID):
                for x in range(GRID):
                    inside = 0 <= x + dx < GRID and 0 <= y + dy < GRID
                    p, q = a["cover"][y, x], b["cover"][y + dy, x + dx] if inside else 0.0
                    inter, union = inter + min(p, q), union + max(p, q)
                    if min(p, q) > 0.05:
                        d = ((a["lab"][y, x] - b["lab"][y + dy, x + dx]) ** 2).sum()
                        cs, cw = cs + min(p, q) * math.exp(-d / (2 * 0.11**2)), cw + min(p, q)
            best = max(best, 0.45 * (inter / union if union else 0) + 0.55 * (cs / cw if cw else 0))
    return 0.8 * best + 0.2 * np.minimum(a["hist"], b["hist"]).sum()


def picture(seed, w, h):
    r = np.random.default_rng(seed)
    out = np.zeros((h, w, 4), np.uint8)
    for _ in range(4):
        x, y = int(r.integers(0, w)), int(r.integers(0, h))
        out[y : y + 1 + h // 2, x : x + 1 + w // 3] = [*r.integers(0, 256, 3), 255]
    out[r.random((h, w)) < 0.02] = [255, 255, 255, 90]
    return out


SIZES = [(9, 12), (30, 20), (64, 64), (90, 130)]


@pytest.mark.parametrize("size", SIZES)
def test_features_equal_the_loop(size):
    pixels = picture(sum(size), *size)
    rgb, weight = shown(pixels)
    got, want = feature(rgb, weight), plain_feature(rgb, weight)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in ("cover", "hist", "aspect")) and np.allclose(got["lab"], want["lab"], atol=2e-3)


def test_likeness_equals_all_shifts_and_survives_packing():
    features = [feature(*shown(picture(k, *SIZES[k % 4]))) for k in range(12)]
    for a in features:
        text = pack(a)
        assert len(text) < 4096 and likeness(a, unpack(text)) > 0.97 and likeness(a, a) > 0.999
        for b in features[:5]:
            assert abs(likeness(a, b) - plain_likeness(a, b)) < 1e-4
    assert pack(None) is None and unpack(None) is None and unpack("???") is None and unpack("AAAA") is None and likeness(None, features[0]) == 0
    assert feature(*shown(np.zeros((5, 5, 4), np.uint8))) is None


def test_an_opaque_ground_is_not_the_picture():
    img = np.full((40, 40, 4), 255, np.uint8)
    img[:, :, :3] = (250, 250, 245)
    img[10:30, 12:28, :3] = (200, 30, 30)
    img[18:22, 18:22, :3] = (250, 250, 245)  # a hole of the ground's colour that the border doesn't reach
    weight = shown(img)[1]
    assert weight[0].sum() == 0 and weight[15, 15] == 1 and weight[20, 20] == 1 and (weight > 0).sum() == 20 * 16


def test_tables_of_pictures(spark):
    rows = [(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in enumerate(picture(k, *SIZES[k % 4]) for k in range(6))]
    rgba = np.dstack([drawn(), np.full(drawn().shape[:2], 255, np.uint8)])
    rows += [(None, rgba.shape[1], rgba.shape[0], bytearray(rgba.tobytes())), (8, 4, 4, None), (9, 4, 4, bytearray(b"123")), (10, 0, 0, bytearray()), (11, 2, 2, bytearray(16)), (1, *rows[1][1:])]
    table = spark.createDataFrame(rows, "id long, width int, height int, pixels binary")
    got = pictures.picture_features(table).collect()
    assert sorted(str(r.id) for r in got) == sorted([str(k) for k in range(6)] + ["None", "11", "1"])
    assert {r.id: r.feature for r in got if r.id in (0, 3, 11)} == {0: pack(feature(*shown(picture(0, *SIZES[0])))), 3: pack(feature(*shown(picture(3, *SIZES[3])))), 11: None}
    assert [tuple(r)[1:] for r in pictures.picture_tiles(table).where("id is null").orderBy("place").collect()] == [(k, *t) for k, t in enumerate(framed_tiles(drawn()))]
    blobs = pictures.picture_blobs(table.where("id = 3"), lambda p: p[:, :, 3] > 0).collect()
    assert sorted(tuple(r)[1:] for r in blobs) == sorted(flood(picture(3, *SIZES[3])[:, :, 3] > 0, True))
    assert pictures.picture_features(table.limit(0)).count() == 0
    likes = pictures.likenesses(spark, "/root/testdata/sf0.001").collect()
    assert len(likes) > 50 and all(0 <= r.likeness <= 1 and r.n_chars < 4096 for r in likes)


def test_random_order_of_pictures_changes_nothing():
    p = [picture(k, 20, 20) for k in range(5)]
    one = [pack(feature(*shown(x))) for x in p]
    random.Random(1).shuffle(p)
    assert sorted(one) == sorted(pack(feature(*shown(x))) for x in p)
