"""Vector codes, ranked search and license scans against plain Python, and in the odd cases they name."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import lexical_search, license_scan, vector_codes

CLASH = ("id", "code", "error", "part", "entry", "n", "s0", "term", "terms", "tfs", "rank", "score", "item", "doc", "labels", "_words", "_id", "a.b", "k")


def clashing(rows):
    return rows.withColumns({c: F.lit("clash") for c in CLASH if c not in rows.columns})


def plain_codes(rows, parts, entries, rounds):
    """(id, code, error, label_error) by comparing everything with everything."""
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dims = len(kept[0][1])
    cut = [dims * i // parts for i in range(parts + 1)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            met = {}
            for _, v, _ in kept:
                met.setdefault(near(part(v, p), book)[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(met[k]) for c in zip(*met[k], strict=True)] if k in met else e for k, e in enumerate(book)]
    out, sums = [], Counter()
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        sums[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, sums[label], digest) for i, code, error, label in out]


@pytest.mark.parametrize(("dims", "entries"), [(10, 5), (4, 40), (16, 256)])
def test_codes_against_plain_python(spark, dims, entries):
    r = random.Random(dims)
    rows = [(i, [float(np.float32(r.choice([r.gauss(0, 1), 0.25, -0.25]))) for _ in range(dims)], r.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[3], rows[7], (7, [0.5] * dims, 1), (None, [0.1] * dims, None), (61, None, 1), (62, [], 2), (63, [None] * dims, 2), (64, [math.nan] + [0.0] * (dims - 1), 1), (65, [math.inf] * dims, 1), (66, [1.0] * (dims + 3), 1)]
    r.shuffle(rows)
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = vector_codes.compress(table, entries=entries, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_codes([(i, v, label) for i, v, label in rows], 4, entries, 3), key=key)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 3)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(none).count() == 0 and vector_codes.compress(none.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 3)], "vec_id long, embedding array<float>, label int")).collect()


@pytest.mark.parametrize("scale", [1, 300, 1 << 26])
def test_bounds_never_rule_out_the_nearest(scale):
    r = np.random.default_rng(scale)
    x, entries = r.integers(-scale, scale + 1, (3000, 16)), r.integers(-scale, scale + 1, (200, 16))
    entries[150] = entries[20]  # a tie
    book = vector_codes.Codebook(entries)
    code, error = book.nearest(x)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    if scale == 1:
        return  # nearly all entries tie
    smooth = np.repeat(r.integers(-scale, scale + 1, (200, 4)), 4, axis=1)
    book = vector_codes.Codebook(smooth)
    book.nearest(smooth[r.integers(0, 200, 1000)])
    assert book.compared < 1000 * 200 / 10  # parts that are even within segments: nearly all entries are ruled out by bounds


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=20):
    """(item, rank, doc, score) by scoring every row for every item."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, total, df = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts), Counter(w for _, c in counts for w in c)
    asked, out = set(), []
    for i, t in items:
        terms = Counter(TERM.findall((t or "").translate(LOWER)))
        if (i, frozenset(terms.items())) in asked:
            continue
        asked.add((i, frozenset(terms.items())))
        found = []
        for d, c in counts:
            m = 75 + 25 * c.total() * n_docs // max(1, total)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, n in terms.items() if c[w])
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(i, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return out


def words(r, n):
    return " ".join(r.choice(["w%d" % int(r.paretovariate(0.6)), "Été", "x_y", "ß", "A1"]) for _ in range(n))


@pytest.mark.parametrize(("slots", "vocabulary", "pairs"), [(1 << 19, 1 << 20, 1 << 21), (25, 0, 128)])
def test_search_against_plain_python(spark, monkeypatch, slots, vocabulary, pairs):
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    r = random.Random(5)
    docs = [(i, words(r, r.randrange(1, 200))) for i in range(400)]
    docs += [docs[5], docs[5], (6, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (900, None), (901, ""), (902, "... --"), (903, "w1 " * 30_000)]
    items = [(i, words(r, r.randrange(1, 40))) for i in range(25)] + [(1, "w2 w3"), (90, None), (91, "?!"), (92, docs[8][1]), (93, "neverseen"), (94, "w1 w1 W1"), (None, "w4 w5")]
    items += [items[2], items[2]]
    table = lambda rows, name: clashing(spark.createDataFrame(rows, f"{name} long, text string").repartition(4))
    got = lexical_search.search(table(docs, "doc_id"), table(items, "item_id"), block_slots=slots, vocabulary_bytes=vocabulary)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(docs, items), key=key)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(x) for x in lexical_search.search(docs, items).collect()] == [tuple(x) for x in plain_search([(1, "a b")], [(1, "a")])]


def test_search_prunes_but_loses_nothing():
    """A rare term with many postings above the threshold leaves common terms without candidates."""
    import pyarrow as pa

    rows = [{"item": "0", "item_id": 7, "term": t, "repeats": 1, "weight": w, "most": w * 400_000, "rest": rest, "seed": 5000 * 390_000} for t, w, rest in (("rare", 5000, 10 * 400_000), ("common", 10, 0))]
    held = lexical_search.Block(rows, 2)
    held.ready()
    n = 500
    lists = pa.array([["common"] if i % 10 else ["rare", "common"] for i in range(n)])
    tfs = np.ones(len(lists.flatten()), np.int64)
    held.meet(np.arange(n), np.zeros(n, bool), np.full(n, 2, np.int64), lists, tfs, n, 2 * n)
    assert held.candidates == n // 10 and held.best[2].tolist() == [0, 10]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    w = WORD.findall((text or "").translate(LOWER))
    found = []
    for label, base, words_, keys in license_scan.templates():
        for s in range(-len(words_), len(w)):
            right = [0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(words_)]
            if all(right[k] for k in keys) and 100 * sum(right) >= 75 * len(words_):
                found.append((label, base, s, sum(right) / len(words_)))
    own = [f[2] for f in found if f[1]]
    return (len(w), len(own), min(own, default=None), max(own, default=None), ",".join(sorted({f[0] for f in found if f[1]})), ",".join(sorted({f[0] for f in found})), max((f[3] for f in found), default=0.0))


def test_license_scan_against_plain_python(spark):
    r = random.Random(9)
    texts = [None, "", "...", "Under the MIT License", "under the MIT\tLicense, under the mit license under the mit", "CC-BY-NC-SA cc by nc", "cc by nc cc by sa", "underthe mit license", "éunder the mit license", "Apache License, Version 2.0", "apache license version 20", "x " * 50_000 + "cc by nc"]
    for label, _, w, keys in license_scan.templates():
        for _ in range(6):  # some words of each notice changed, inserted or cut off
            t = [x if r.random() > 0.12 else r.choice(["the", "foo", x.upper()]) for x in w]
            t = t[r.choice([0, 0, 1]) :] if r.random() < 0.7 else [*t[: len(t) // 2], "inserted", *t[len(t) // 2 :]]
            texts.append(f"{label} is not a licence, {r.choice(['', 'but under the MIT license '])}" + r.choice([" ", "\n", "-"]).join(t) + r.choice(["", " and more of the license"]))
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id long, text string").repartition(3)
    docs = clashing(docs)
    got = license_scan.scan(docs)
    rows = sorted(((str(x.doc_id), *x[1:8]) for x in got.collect()), key=str)
    assert rows == sorted(((str(i), *plain_scan(t)) for i, t in [*enumerate(texts), (3, texts[3]), (None, texts[4])]), key=str)
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert {x for row in rows for x in row[6].split(",")} >= {"gpl-3", "isc", "mpl-2", "bsd", "cc0"}


def test_license_scan_is_the_same_for_any_anchors(spark):
    entries = license_scan.templates()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["under the mit license " * 3, "cc by nc", "released under the gnu general public license version 3"])], "doc_id long, text string")
    w = license_scan.words_of(F.col("text"))
    answers = []
    for frequency in ({}, {"the": -1, "by": -2, "public": -3}, {x: k for k, x in enumerate(sorted({x for e in entries for x in e[2]}))}):
        for anchors in (1, 3):
            table = license_scan.index(entries, frequency, anchors)
            found = F.array_intersect(w, F.array_distinct(F.flatten(F.transform(table, lambda t: F.transform(t["anchors"], lambda a: a["word"])))))
            answers.append([r[0] for r in docs.orderBy("doc_id").select(license_scan.places(w, found, table)).collect()])
    assert all(a == answers[0] for a in answers) and len(answers[0][0]) == 3


def test_license_scan_has_no_python_in_its_plan(spark):
    plan = license_scan.op13_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
