"""Popup data of catalogue pages: a JSON map from names to fields, of any shape, and cards that it completes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, parse_number, squeezed
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}

#: The keys of each field, letters only, in order.
POPUP_FIELDS = {
    "value": ("value", "val", "supreme"),
    "range": ("range", "rangedvalue", "valuerange", "ranged"),
    "demand": ("demand",),
    "rarity": ("rarity",),
    "stability": ("stability", "trend"),
    "change": ("change", "changeinvalue", "lastchange"),
    "origin": ("origin",),
    "aliases": ("aliases", "alias"),
    "contains": ("contains", "items", "setitems"),
    "image": ("image", "img", "imageurl", "imagesrc", "icon", "thumbnail", "picture"),
}
_START = re.compile(r"_svPopup\s*=\s*")
#: Lists within lists that are told as text; what lies deeper is told as JSON.
NESTED = 4


def popup_entries(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, entry, own, pos, key, value) of the JSON object that a page assigns to its popup variable: its entries that are objects, with the keys and values (JSON texts) of each, in order.

    The object ends where its braces do, whatever follows. Of a key that repeats the last value counts. An entry
    without keys is a row without one. Pages without a popup, with a broken one, or with another value give no row.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", "entry", "own", "pos", "key", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = json.JSONDecoder(parse_constant=lambda _: None).raw_decode
        for b in batches:
            at, rows = [], []
            for k, html in enumerate(b.column(1).to_pylist()):
                start = _START.search(html or "")
                try:
                    data = read(html, start.end())[0] if start else None
                    found = [(n, own, i, key, json.dumps(v)) for n, (own, info) in enumerate(data.items()) if isinstance(info, dict) for i, (key, v) in enumerate([*info.items()] or [(None, None)])] if isinstance(data, dict) else []
                except (ValueError, RecursionError):
                    continue
                at += [k] * len(found)
                rows += found
            if rows:
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, f"id {kind}, entry int, own string, pos int, key string, value string")


def plain_text(value: Column, depth: int = NESTED) -> Column:
    """A variant as text without markup: two numbers of a list are a range, other lists are joined; null is ''."""
    kind = F.schema_of_variant(value)
    entities = F.regexp_replace(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)), "<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        entities = F.replace(entities, F.lit(name), F.lit(sign))
    one = F.coalesce(squeezed(entities), F.lit(""))
    if depth:
        pair = lambda parts: (F.size(parts) == 2) & F.forall(parts, lambda t: parse_number(t).isNotNull())
        joined = lambda parts: F.when(pair(parts), F.array_join(parts, " - ")).otherwise(F.array_join(parts, ", "))
        parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: plain_text(v, depth - 1))
        one = F.when(kind.startswith("ARRAY"), F.get(F.transform(F.array(parts), joined), F.lit(0))).otherwise(one)  # parts are told once
    return F.when(value.isNull() | (kind == "VOID"), "").otherwise(one)


def popup_fields(entries: DataFrame) -> DataFrame:
    """(id, name, fields) of ``popup_entries``: each name with its fields that are not empty (POPUP_FIELDS), told as text.

    Keys are compared by their letters; of those of one field the first in order that is not empty counts, and of
    equal ones the last. A name that an entry says within its fields is the name. Of names that are the same the last
    entry counts.
    """
    rank = {key: (field, k) for field, keys in POPUP_FIELDS.items() for k, key in enumerate(keys)} | {"name": ("name", 0)}
    known = F.create_map(*[x for key, (field, k) in rank.items() for x in (F.lit(key), F.struct(F.lit(field).alias("field"), F.lit(k).alias("rank")))])
    told = entries.withColumn("letters", F.regexp_replace(F.lower("key"), "[^a-z]", "")).withColumn("f", F.try_element_at(known, F.col("letters"))).where("f is not null")
    last = told.groupBy("id", "entry", "letters").agg(F.max_by(F.struct("f", "value"), "pos").alias("x")).select("id", "entry", "x.*")
    text = plain_text(F.try_parse_json("value"))
    first = last.select("id", "entry", "f", text.alias("text")).where("text <> ''").groupBy("id", "entry", "f.field").agg(F.min_by("text", "f.rank").alias("text"))
    maps = first.groupBy(F.col("id").alias("_i"), F.col("entry").alias("_e")).agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("all"))  # eleven fields
    rows = entries.groupBy("id", "entry").agg(F.first("own").alias("own")).join(maps, F.col("id").eqNullSafe(F.col("_i")) & (F.col("entry") == F.col("_e")), "left")
    name = squeezed(F.coalesce(F.try_element_at("all", F.lit("name")), F.col("own")))
    empty = F.create_map().cast("map<string,string>")
    rows = rows.select("id", "entry", name.alias("name"), F.coalesce(F.map_filter("all", lambda k, _: k != "name"), empty).alias("fields"))
    return rows.groupBy("id", "name").agg(F.max_by("fields", "entry").alias("fields"))


def completed_cards(cards: DataFrame, popups: DataFrame) -> DataFrame:
    """(id, name, fields, from_popup) of cards (id, name, fields) with what popups (id, name, fields) add: a field that a
    card lacks, and the name as the popup writes it. Where a page has no card at all, its popup's entries are the cards."""
    key = lambda c: name_key(F.col(c))
    known = popups.select(F.col("id").alias("_i"), key("name").alias("_k"), F.col("name").alias("_name"), F.col("fields").alias("_fields"))
    known = known.groupBy("_i", "_k").agg(F.max_by(F.struct("_name", "_fields"), F.struct("_name")).alias("x")).select("_i", "_k", "x.*")
    met = cards.select("id", "name", "fields", key("name").alias("key")).join(known, F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left")
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce("fields", empty), F.coalesce("_fields", empty), lambda _, own, other: F.coalesce(own, other))
    out = met.select("id", F.coalesce("_name", "name").alias("name"), both.alias("fields"), F.lit(False).alias("from_popup"))
    pages = cards.select(F.col("id").alias("_i")).distinct()
    alone = popups.join(pages, F.col("id").eqNullSafe(F.col("_i")), "left_anti").select("id", "name", "fields", F.lit(True).alias("from_popup"))
    return out.unionByName(alone)


def popup_items(spark, sf_dir: str) -> DataFrame:
    """Popups within pages, in shapes that take turns by page, broken ones among them; a row for each field of each name."""
    p = table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    shapes = [
        ('{"Ice Wing": {"Value": "', '", "Demand": 7, "range": [10, "1,5K"]}, "Seer": {"VAL": "<b>12</b> &amp; up", "Alias": ["a", ["b", "c"]]}};'),
        ('{"k1": {"name": "Chroma Seer", "Ranged Value": ["', '", "x"], "rarity": null, "Image_URL": "i.png", "img": "j.png"}, "no": 5} ; var x = {"a": 1};'),
        ('{"Elder": {"supreme": ', ', "trend": "Doing  Well"}, "Broken": {"value": }'), ('[{"value": "', '"}]'),
    ]
    text = F.lit(None).cast("string")
    for k, (a, b) in enumerate(shapes):
        text = F.when(F.col("page_id") % 5 == k, F.concat(F.lit(a), number, F.lit(b))).otherwise(text)
    html = F.concat(F.col("html"), F.coalesce(F.concat(F.lit("<script>var _svPopup = "), text, F.lit("</script>")), F.lit("")))
    found = popup_fields(popup_entries(p.select("page_id", html.alias("html"))))
    return found.select(F.col("id").alias("page_id"), "name", F.explode("fields").alias("field", "text"))


QUERIES["popup_items"] = popup_items
ORACLES["popup_items"] = """
SELECT page_id, v[1] AS name, v[2] AS field, replace(v[3], '#', page_id::VARCHAR) AS text FROM pages, (VALUES (0, ['Ice Wing', 'value', '#']), (0, ['Ice Wing', 'demand', '7']), (0, ['Ice Wing', 'range', '10 - 1,5K']), (0, ['Seer', 'value', '12 & up']),
  (0, ['Seer', 'aliases', 'a, b, c']), (1, ['Chroma Seer', 'range', '#, x']), (1, ['Chroma Seer', 'image', 'j.png'])) t(shape, v) WHERE page_id % 5 = shape AND html IS NOT NULL"""
