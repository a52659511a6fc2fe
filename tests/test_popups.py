"""Popups of pages against json and plain Python, over shapes, aliases, nested ranges and broken ones."""

import html
import json
import random
import re

from pyspark.sql import functions as F

from lotwise.operators.popups import POPUP_FIELDS, completed_cards, popup_entries, popup_fields


def number(t):
    return bool(re.fullmatch(r"\d[\d,]*(\.\d+)?\s*[KkMmBb]?", t.strip(" *~≈+")))


def plain(v):
    if v is None:
        return ""
    if isinstance(v, list):
        parts = [plain(x) for x in v]
        return f"{parts[0]} - {parts[1]}" if len(parts) == 2 and all(map(number, parts)) else ", ".join(parts)
    v = json.dumps(v) if not isinstance(v, str) else v
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", v)).split())


def expected(page):
    start = re.search(r"_svPopup\s*=\s*", page or "")
    try:
        data = json.JSONDecoder().raw_decode(page, start.end())[0] if start else None
    except (ValueError, RecursionError):
        return {}
    out = {}
    for own, info in data.items() if isinstance(data, dict) else ():
        if not isinstance(info, dict):
            continue
        keys = {re.sub("[^a-z]", "", k.lower()): v for k, v in info.items()}
        fields = {}
        for field, names in POPUP_FIELDS.items():
            text = next((t for t in (plain(keys[n]) for n in names if n in keys) if t), None)
            if text:
                fields[field] = text
        out[" ".join((plain(keys.get("name")) or own).split())] = fields
    return out


def value(r, deep=0):
    return r.choice([None, "", 7, 12, 126000, "2,600", "1.5M", "N/A", "<b>Doing</b> Well", "a &amp; b&nbsp;c", "  ", True, "Überpaid é", [10, 15], ["1K", "2,5K"], [1, "x"], [], ["a"], "[10 - 15]"] + ([[value(r, deep + 1), value(r, deep + 1)], [value(r, deep + 1)] * 3] if deep < 2 else []))


def test_popups_against_json(spark):
    r = random.Random(12)
    keys = [k for names in POPUP_FIELDS.values() for k in names] + ["name", "Name", "Value!", "Ranged Value", "RANGE", "image_url", "other", "a.b", "x'y", ""]
    pages = []
    for _ in range(150):
        data = {r.choice(["Ice Wing", "Seer", "C. Bat", " Odd  Name ", "k%d" % r.randrange(9)]): r.choice([{r.choice(keys): value(r) for _ in range(r.randrange(6))}, {r.choice(keys): value(r) for _ in range(5)}, 5, None, [1]]) for _ in range(r.randrange(4))}
        text = json.dumps(data, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        text = r.choice([text, text, text, text[: len(text) // 2], text.replace(":", "", 1), json.dumps([data])])
        pages.append(f"<html><script>var _svPopup{r.choice(['=', ' = '])}{text};var z = {{'a': 1}};</script>")
    pages += [None, "", "no popup", "_svPopup = ", "_svPopup = " + '{"a":' * 60_000, '_svPopup = {"Twice": {"value": 1, "value": 2, "VALUE": 3}, "Twice": {"value": 9}, "Same": {"name": "Twice", "demand": 4}} trailing', '_svPopup={"Nan": {"value": NaN}}']
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("name", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {}
    for x in popup_fields(popup_entries(table)).collect():
        assert x.name not in got.setdefault(x.id, {})
        got[x.id][x.name] = x.fields
    want = {k: e for k, p in enumerate(pages) if (e := expected(p))}
    assert got.pop(len(pages) - 1) == {"Nan": {}}
    want.pop(len(pages) - 1)
    assert got == want
    assert popup_fields(popup_entries(table.limit(0))).count() == 0


def test_cards_are_completed(spark):
    row = "id long, name string, fields map<string,string>"
    cards = spark.createDataFrame([(1, "ice  wing", {"value": "5"}), (1, "Unknown", None), (None, "Seer", {})], row)
    popups = spark.createDataFrame([(1, "Ice Wing", {"value": "9", "demand": "3"}), (1, "Only Here", {"value": "1"}), (2, "Elder", {"value": "7"}), (None, "SEER", {"rarity": "2"})], row)
    got = {(x.id, x.name): (x.fields, x.from_popup) for x in completed_cards(cards, popups).collect()}
    assert got == {(1, "Ice Wing"): ({"value": "5", "demand": "3"}, False), (1, "Unknown"): ({}, False), (None, "SEER"): ({"rarity": "2"}, False), (2, "Elder"): ({"value": "7"}, True)}
