"""License scans by a positional index of rare words; DataFrame functions only.

A template is a run of words with mandatory key phrases in it. Of each template the key words that the fewest documents
hold (the highest inverse document frequency) are its anchors, and the index has their places in it. A file looks up the
anchors that it holds; a template is open where all of its anchors are there. The places of an open template's rarest
anchor say where it would start; a start stays if every other anchor stands at its relative place, then if every word
of the key phrases does, and a template counts with the share of its words that stand where they should. As key words
are mandatory, the choice of anchors changes the work, never the result.

The index is a constant of some twenty templates. Each row is scanned on its own; only the counts of licence words
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are licences by themselves, and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Notices of common licences: label, words, and in brackets the key phrases that must stand at their place.
NOTICES = [
    ("agpl-3", "[gnu affero general public license] version [3]"),
    ("all-rights-reserved", "[all rights reserved]"),
    ("apache-2", "unless required by applicable law or agreed to in writing software [distributed under the license is distributed on an as is basis] without warranties or conditions of any kind"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted [provided that the following conditions are met]"),
    ("cc-by", "[creative commons attribution 4 0] international license"),
    ("cc-by-nc", "[creative commons attribution noncommercial] 4 0 international license"),
    ("cc-by-sa", "[cc by sa]"),
    ("cc-by-sa", "[creative commons attribution sharealike] 4 0 international license"),
    ("cc0", "[cc0 1 0] universal"),
    ("gpl-2", "[gnu general public license version 2]"),
    ("gpl-2", "under the terms of the [gnu general public license] as published by the free software foundation either [version 2 of the license] or at your option any later version"),
    ("gpl-3", "[gnu general public license version 3]"),
    ("gpl-3", "under the terms of the [gnu general public license] as published by the free software foundation either [version 3 of the license] or at your option any later version"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose [with or without fee is hereby granted]"),
    ("lgpl", "under the terms of the [gnu lesser general public license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction]"),
    ("mpl-2", "this source code form is [subject to the terms of the mozilla public license v 2 0]"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
]
#: Per cent of a template's words that stand at their place, and anchors of a template.
SHARE, ANCHORS = 75, 3


def templates(notices: Iterable[tuple[str, str]] = NOTICES, base: Iterable[tuple[str, str]] = BASE) -> list[tuple[str, bool, list[str], list[int]]]:
    """Label, whether it is a base phrase, words, and the places of the mandatory ones."""
    out = [(label, True, phrase.split(), list(range(len(phrase.split())))) for label, phrase in base]
    for label, text in notices:
        words, keys, inside = [], [], False
        for token in text.split():
            inside = inside or token.startswith("[")
            if inside:
                keys.append(len(words))
            words.append(token.strip("[]"))
            inside = inside and not token.endswith("]")
        if not keys:
            raise ValueError(f"a notice of {label} has no key phrase")
        out.append((label, False, words, keys))
    return out


def words_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: Iterable[str]) -> dict[str, int]:
    """How many documents hold each of the vocabulary's words; counted over all of them, a row a word comes back."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(f"`{text_col}`")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def index(entries: list[tuple[str, bool, list[str], list[int]]], frequency: dict[str, int], anchors: int = ANCHORS) -> Column:
    """The positional index: templates, each with its anchors, the rarest first."""
    rows = []
    for label, base, words, keys in entries:
        rare = sorted(keys, key=lambda k: (frequency.get(words[k], 0), k))
        place: dict[str, int] = {}
        for k in rare:
            place.setdefault(words[k], k)
        chosen = list(place.items())[:anchors]
        rows.append(F.struct(
            F.lit(label).alias("label"), F.lit(base).alias("base"), F.array(*map(F.lit, words)).alias("words"), F.array(*map(F.lit, keys)).alias("keys"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("at")) for w, k in chosen]).alias("anchors"),
        ))
    return F.array(*rows)


def places(words: Column, found: Column, templates: Column, share: int = SHARE) -> Column:
    """Where templates stand in the words: label, base, start and share; ``found`` are the anchors that the file holds."""
    stands = lambda word, at: F.coalesce(F.get(words, at) == word, F.lit(False))

    def of(t: Column) -> Column:
        rarest = F.get(t["anchors"], F.lit(0))
        starts = F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: stands(rarest["word"], i)), lambda i: i - rarest["at"])
        starts = F.filter(starts, lambda s: F.forall(t["anchors"], lambda a: stands(a["word"], s + a["at"])))
        starts = F.filter(starts, lambda s: F.forall(t["keys"], lambda k: stands(F.get(t["words"], k), s + k)))
        right = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda k: stands(F.get(t["words"], k), s + k)))
        told = F.transform(starts, lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), (right(s) / F.size(t["words"])).alias("share")))
        return F.filter(told, lambda x: x["share"] * 100 >= share)

    open_ = F.filter(templates, lambda t: F.forall(t["anchors"], lambda a: F.array_contains(found, a["word"])))
    return F.when(F.size(found) > 0, F.flatten(F.transform(open_, of)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Iterable[tuple[str, str]] = NOTICES, base: Iterable[tuple[str, str]] = BASE, share: int = SHARE) -> DataFrame:
    """Per row of docs: id, n_words, the places of base phrases (n_base, first_word, last_word), base_labels, labels, score, and places.

    Words are runs of a-z, 0-9 and anything beyond ASCII after A-Z are lower-cased; null and empty texts have none.
    ``score`` is the largest share of a template's words that stand in the text, 0 without a label; labels are '' where
    there are none. A notice may begin before the text or end after it as long as its key phrases are within. Repeated
    rows give equal rows, an empty table gives an empty result, and other columns are not read. A text's words are held
    in memory together.
    """
    entries = templates(notices, base)
    frequency = document_frequencies(docs, text_col, sorted({w for _, _, words, _ in entries for w in words}))
    table = index(entries, frequency)
    anchors = F.array_distinct(F.flatten(F.transform(table, lambda t: F.transform(t["anchors"], lambda a: a["word"]))))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), words_of(F.col(f"`{text_col}`")).alias("_words"))
    rows = rows.withColumn("_found", F.array_intersect("_words", anchors))
    rows = rows.withColumn("_places", F.coalesce(places(F.col("_words"), F.col("_found"), table, share), F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")))
    own = F.filter("_places", lambda x: x["base"])
    start = F.transform(own, lambda x: x["start"].cast("long"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return rows.select(
        F.col("_id").alias(id_col), F.size("_words").cast("long").alias("n_words"), F.size(own).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.col("_places")).alias("labels"), F.coalesce(F.array_max(F.transform("_places", lambda x: x["share"])), F.lit(0.0)).alias("score"), F.col("_places").alias("places"),
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("score", F.round("score", 6)).drop("places")


def scan_sql() -> str:
    """The same in SQL: every licence word votes for every start, and votes are counted; no anchors, no frequencies."""
    rows = [(i, label, base, len(words), k, w, k in keys) for i, (label, base, words, keys) in enumerate(templates()) for k, w in enumerate(words)]
    values = ", ".join(f"({i}, '{label}', {str(base).lower()}, {n}, {k}, '{w}', {str(key).lower()})" for i, label, base, n, k, w, key in rows)
    return rf"""
WITH t (tno, label, base, n, k, word, is_key) AS (VALUES {values}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
v AS (SELECT doc_id, tno, label, base, n, pos - k AS start, count(*) AS hits, count(*) FILTER (is_key) AS keys FROM x JOIN t USING (word) GROUP BY ALL),
p AS MATERIALIZED (SELECT * FROM v JOIN (SELECT tno, count(*) FILTER (is_key) AS all_keys FROM t GROUP BY tno) USING (tno) WHERE keys = all_keys AND hits * 100 >= {SHARE} * n),
s AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(hits / n) AS score FROM p GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN s USING (doc_id)"""


OP13_SQL = scan_sql()
