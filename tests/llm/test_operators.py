"""The numbered operators against SQL, brute force, round trips and held-out accuracy, and in the odd cases they name."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lotwise.llm import chat_format, embedding_dedup, exact_dedup, langid, mixing, ngram_join, registry, repeat_removal, sentencepiece_sampling, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def documents(spark, texts, ids=None):
    """Rows with nulls, repeats, and columns with names of results."""
    rows = [(i, t, None, "s", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    extra = {c: F.lit("clash") for c in ("keep_id", "kept", "id", "label", "batch", "score", "digest", "_w", "_key", "a.b")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra)


TEXTS = [None, "", "   ", "one", "One", "a b c d e f g", "a b c d e f g", "A  b c d e f g", "x " * 40_000, "12 34", "é" * 900, None]


def test_exact_dedup_of_repeated_rows(spark):
    docs = documents(spark, ["a", "a", "b", "a b", "a  b", None, ""], [3, 3, 3, None, 7, None, None])
    got = sorted((str(r.doc_id), r.text or "", str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, fan_in=2, memtable_rows=1).collect())
    want = [("3", "a", "3", 2, True), ("3", "a", "3", 2, True), ("3", "b", "3", 1, True), ("None", "a b", "7", 2, False), ("7", "a  b", "7", 2, True), ("None", "", "None", 2, True), ("None", "", "None", 2, True)]
    assert got == sorted(want)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == 6 and exact_dedup.kept_rows(docs.limit(0)).count() == 0


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    assert [got[i].keep_id for i in (0, 1, 11, 5, 6, 2)] == [0, 0, 0, 5, 5, 2]
    assert got[0].group_size == 3 and got[5].group_size == 2 and not got[6].kept
    few = exact_dedup.exact_dedup(documents(spark, TEXTS), digest_bits=8, memtable_rows=2)  # collisions, many runs
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in few.collect()} == {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()}
    assert exact_dedup.exact_dedup(documents(spark, []).limit(0)).count() == 0


def test_exact_dedup_of_a_text_that_a_third_of_all_rows_hold(spark, monkeypatch):
    """What meets in a range follows the runs, not the rows: no group of a task holds the copies of the frequent text."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("own "), F.col("id") - F.col("id") % 2)).alias("text"))
    groups, written = [], exact_dedup.written

    def seen(df, name, *rest):
        out = written(df, name, *rest)
        if name == "runs":
            keys = out.select("range", (F.length("keys") / 32).alias("keys"), F.size("ids").alias("ids"))
            groups.extend(keys.groupBy("range").agg(F.sum("keys").alias("keys"), F.sum("ids").alias("ids"), F.count("*").alias("runs")).collect())
        return out

    monkeypatch.setattr(exact_dedup, "written", seen)
    got = exact_dedup.exact_dedup(rows, memtable_rows=1_500)
    stats = got.agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.max("group_size").alias("most"), F.count("*").alias("n"), F.max(F.when(F.col("text") == "the same", F.col("keep_id"))).alias("low")).first()
    texts = rows.select("text").distinct().count()
    assert (stats.kept, stats.most, stats.n, stats.low) == (texts, 10_000, 30_000, 0)
    hot = max(groups, key=lambda r: r.ids)
    others = [r.keys for r in groups if r is not hot]
    assert hot.ids > 10_000 and hot.keys <= max(others) * 1.3 + hot.runs


def shingle_sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def component_ids(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(seed=3):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    base = [r.choice(words) for _ in range(120)]
    texts = []
    for _ in range(60):  # a chain of near copies around the threshold
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t[: r.randrange(90, 121)]))
    return texts + [" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(40)] + TEXTS


def test_ngram_join_against_all_pairs(spark):
    texts = near_copies()
    sets = shingle_sets(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(documents(spark, texts)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, component_ids(sets), strict=True))}
    assert ngram_join.jaccard_join(documents(spark, []).limit(0)).count() == 0


def short_pairs(seed=5):
    """Texts of 3 to 12 words, each also extended by a word at one end; words are not shared between pairs."""
    r = random.Random(seed)
    texts = []
    for i in range(150):
        words = ["p%dw%d" % (i, k) for k in range(8 if i < 100 else r.randrange(4, 14))]
        texts += [" ".join(words), " ".join(words[1:] if i % 2 else words[:-1])]
    return texts


@pytest.mark.parametrize("percent", [75, 50])
def test_ngram_join_of_short_texts_against_all_pairs(spark, percent):
    texts = short_pairs()
    sets = shingle_sets(texts)
    want = [i - i % 2 if 100 * len(sets[i] & sets[i ^ 1]) >= percent * len(sets[i] | sets[i ^ 1]) else i for i in range(len(sets))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(documents(spark, texts), percent=percent).collect()}
    assert sum(got[i] != c for i, c in enumerate(want)) == 0


def test_repeat_removal_against_brute_force(spark):
    r = random.Random(1)
    base = "".join(r.choice("abcdefgh \né") for _ in range(2500))
    texts = [None, "", "a" * 3000, "ab" * 400, base, base[100:1500] + "x" + base[1500:], base[:399], base[:400], base[:401], base[2000:2400] * 2, "z" + base[5:500]]
    ids = [None, *range(1, len(texts))]
    for length, hot in ((400, repeat_removal.HOT), (64, repeat_removal.HOT), (400, 3)):  # 3: strings of frequent anchors are counted
        got = {x.doc_id: x for x in repeat_removal.remove_repeats(documents(spark, texts, ids), length=length, texts=True, hot=hot).collect()}
        want = repeat_removal.removed_by_force([None if t is None else t.encode() for t in texts], length)
        assert {i: (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in ids} == dict(zip(ids, want, strict=True))
        assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got.values())
    assert repeat_removal.remove_repeats(documents(spark, []).limit(0)).count() == 0


def test_repeat_removal_of_a_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = repeat_removal.removed_by_force([None if d.text is None else d.text.encode() for d in docs])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in registry.QUERIES["op10_repeat_removal"](spark, "/root/testdata/sf0.01").collect()}
    assert got == dict(zip([d.doc_id for d in docs], want, strict=True))


def test_repeat_removal_leaves_shared_passages_shorter_than_its_strings(spark):
    """Passages of over 50 words can be shorter than 400 bytes: they stay by the contract's length and go by a shorter one."""
    items = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if len(x.text.split()) > 50]
    assert items and all(256 < len(x.encode()) < 400 for x in items)
    texts = [f"{i} {k} {'<>'[k]}{x}{'{}'[k]} {k} {i}" for i, x in enumerate(items) for k in (0, 1)]
    whole = repeat_removal.remove_repeats(documents(spark, texts)).collect()
    assert len(whole) == len(texts) and all(x.n_removed == 0 and not x.has_repeats for x in whole)
    short = {x.doc_id: x for x in repeat_removal.remove_repeats(documents(spark, texts), length=256, texts=True).collect()}
    assert [(short[i].n_removed, short[i].n_spans) for i in range(len(texts))] == [(len(items[i // 2].encode()), 1) for i in range(len(texts))]
    assert [bytes(short[i].kept).decode() for i in range(len(texts))] == [t.replace(items[i // 2], "") for i, t in enumerate(texts)]


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    model = langid.fit(docs)
    odd = {r.doc_id: r for r in langid.identify(documents(spark, TEXTS), model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[9].lang_pred == "und" and odd[0].score == 0.0 and not odd[0].accepted
    assert 0 <= odd[8].score <= 1
    assert langid.fit(documents(spark, TEXTS)) is None
    assert {r.lang_pred for r in langid.identify(documents(spark, TEXTS), None).collect()} == {"und"}


def test_language_id_against_sums_of_one_text():
    """The vectorised prediction against a loop over the bytes of each text."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], r.normal(size=(1 << langid.BITS, langid.DIM)).astype(np.float32), r.normal(size=(langid.DIM, 3)), r.normal(size=3), 1.7)
    texts = ["Ab cd!", "éa  zz", "x", "word " * 50, "12 3", ""]
    best, score = langid.predict_arrays(model, pa.array(texts, pa.large_string()))
    for t, i, p in zip(texts, best, score, strict=True):
        x = [langid._FOLD[c] for c in t.encode()]
        total, n = np.zeros(langid.DIM), 0
        for k in langid.ORDERS:
            for s in range(len(x) - k + 1):
                if all(c == 0x20 for c in x[s : s + k]):
                    continue
                h = int(x[s]) * int(langid._MULT[0]) % 2**32
                for j in range(1, k):
                    h = (h + (int(x[s + j]) + j) * int(langid._MULT[j])) % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 32 - langid.BITS
                total, n = total + model.embed[h], n + 1
        if not n:
            assert i == -1 and p == 0
            continue
        z = (total / n @ model.weight + model.bias) / model.heat
        z = np.exp(z - z.max())
        assert i == z.argmax() and abs(p - (z / z.sum()).max()) < 1e-4


def test_language_id_edges(spark):
    docs = documents(spark, [*TEXTS, "ein Satz " * 9], [None, 1, 1, *range(3, len(TEXTS) + 1)]).withColumn("lang", F.lit("de"))
    model = langid.fit(docs)
    assert langid.identify(docs, model).count() == len(TEXTS) + 1 and langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None
    same = langid.accepted_rows(docs, model)
    assert same.columns == docs.columns and {r.score for r in same.collect()} <= {"clash"}


def test_language_id_of_texts_of_few_bytes(spark):
    """Texts shorter than the longest n-gram, in the sample and alone in a chunk: sf0.1 has one of two bytes among 10,000."""
    import pyarrow as pa

    texts, ids = ["A.", "zu", "é", "x", "le", "und", "et la", "A."], [0, *range(7, 14)]  # none held out
    docs = documents(spark, texts, ids).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    model = langid.fit(docs)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    best, score, cover = langid.measured(model, pa.array(texts, pa.large_string()))
    for i, (t, k) in enumerate(zip(texts, ids, strict=True)):
        alone = langid.measured(model, pa.array([t], pa.large_string()))
        assert [x[0] for x in alone] == pytest.approx([best[i], score[i], cover[i]])
        assert best[i] < 0 or (got[k].lang_pred, got[k].score) == (model.langs[best[i]], pytest.approx(score[i]))
    assert (best < 0).tolist() == [len(t.encode()) < 2 for t in texts]


def test_sentencepiece_round_trip(spark):
    texts = [*TEXTS, "▁▁ mixed ▁ spaces  and\ttabs\n", " lead", "中文 und Wörter 🙂", "<unk></s>"]
    enc = sentencepiece_sampling.encode(documents(spark, texts), digest=True).cache()
    back = {r.doc_id: r.text for r in sentencepiece_sampling.decode(enc).collect()}
    assert back == dict(enumerate(texts))
    sha = {r.doc_id: r.text_sha256 for r in enc.collect()}
    assert sha == {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    again = sentencepiece_sampling.encode(documents(spark, texts).repartition(5))
    assert {r.doc_id: r.pieces for r in again.collect()} == {r.doc_id: r.pieces for r in enc.collect()}
    other = sentencepiece_sampling.encode(documents(spark, texts), seed=99)
    assert {r.doc_id: r.pieces for r in other.collect()} != {r.doc_id: r.pieces for r in enc.collect()}


def test_sentencepiece_samples_by_the_weights_of_all_segmentations():
    """A word of which every segmentation is written out, against the shares of many draws."""
    import numpy as np

    v = sentencepiece_sampling.pieces()
    known = {bytes(v.blob[v.off[i] : v.off[i + 1]]): i for i in range(v.size) if np.isfinite(v.weight[i]) and v.off[i + 1] > v.off[i] and i not in set(v.byte_id.tolist())}

    def all_of(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                for more in all_of(rest[k:]):
                    yield (known[rest[:k]], *more)

    for word in (b"lower", b"a b"):
        ways = list(all_of(b" " + word)) if b" " not in word else [x + y for x in all_of(b" a") for y in all_of(b" b")]
        weight = np.array([np.exp(sum(v.weight[i] for i in way)) for way in ways])
        draws = 20_000
        ids, n = sentencepiece_sampling.sample(v, np.frombuffer(word * draws, np.uint8), np.arange(draws + 1) * len(word), sentencepiece_sampling.row_seed(list(range(draws))))
        cut = np.concatenate([[0], np.cumsum(n)])
        seen = {}
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            way = tuple(ids[x:y].tolist())
            seen[way] = seen.get(way, 0) + 1 / draws
        assert set(seen) <= set(ways)
        assert max(abs(seen.get(way, 0) - p) for way, p in zip(ways, weight / weight.sum(), strict=True)) < 0.015


def test_sentencepiece_long_segments_are_filtered_alike():
    import numpy as np

    v = sentencepiece_sampling.pieces()
    data = np.frombuffer(" the lower éü segments".encode() + b"qzx", np.uint8)
    _, w = sentencepiece_sampling.lattice(v, data, np.array([0, len(data)]))
    one = np.empty(w.shape, np.float32)
    sentencepiece_sampling.forward_one(w, one)
    assert np.allclose(one, sentencepiece_sampling.forward(w, np.array([0, len(data)])), atol=1e-6)


def test_sentencepiece_of_a_long_text_without_spaces(spark):
    text = "abcdefghij" * 30_000
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x")], "doc_id long, text string")
    rows = sentencepiece_sampling.encode(docs, digest=True).collect()
    assert [r.text_sha256 for r in rows if r.doc_id == 1] == [hashlib.sha256(text.encode()).hexdigest()] * 2 and len(rows) == 3
    assert sentencepiece_sampling.encode(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = documents(spark, [*TEXTS, *["w " * 60] * 50])
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(got) == len(TEXTS) + 50 and got[0].kept and got[0].p == 1.0 and got[0].weight == 0.0
    assert all(0 <= r.p <= 1 for r in got.values())
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "source string, lang string, tokens long")
    goals = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.3), ("y", 0.7)], "lang string, target double")}
    raked = mixing.rake(cells, goals).cache()
    for dim, target in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"x": 0.3, "y": 0.7})):
        assert {r[0]: r[1] for r in raked.groupBy(dim).agg(F.sum("w")).collect()} == pytest.approx(target, abs=1e-6)


def test_embedding_dedup_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1))).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1)} | {i: (0, i) for i in range(4, 11)}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é\r\n\r\nWARC/1.1\r\n" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages, archive_bytes=300)).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "response", 3: "revisit", 4: "response", 5: "response"}
    assert got[1].refers_to == 2 and got[3].refers_to == 4 and all(r.verified for r in got.values())
    assert bytes(got[5].payload) == rows[4][2].encode() and got[5].payload_bytes == len(rows[4][2].encode())
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "{}/with space, 100%25 and #1"])
def test_warc_in_folders_of_any_spelling(spark, tmp_path, monkeypatch, form):
    monkeypatch.setattr(warc, "scratch", lambda spark, name: f"{form.format(tmp_path)}/{name}")
    manifest = warc.write_warc(spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x")], "page_id long, url string, html string"))
    folder = form.format(tmp_path).removeprefix("file:").removeprefix("//")
    assert all(r.path.startswith(f"file://{folder}/warc/part-") for r in manifest.collect())
    assert sorted((r.page_id, r.refers_to, r.verified) for r in warc.read_warc(manifest).collect()) == [(1, 2, True), (2, None, True)]
    assert [p.name for p in tmp_path.rglob("*:*")] == []


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://www.example.com", "https://a.net/es/1", "https://net/fr/", "https://xnet/fr/", "ftp://h?q", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("html", F.lit(""))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert {i: (r.host, r.path) for i, r in got.items()} == {i: host_path(u) for i, u in enumerate(urls)}
    assert {i: r.rule for i, r in got.items()} == {0: None, 1: None, 2: None, 3: "example.com/en/", 4: "www.example.com/en/", 5: "com/" if host_path(urls[5])[1].startswith("/") else None, 6: "net/es/", 7: "net/fr/", 8: None, 9: None, 10: None}
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_trees_learn_from_the_labelled_urls(spark):
    """Hosts without a rule are judged by what their URLs look like: long, deep and full of digits is blocked here."""
    r = random.Random(5)
    bad = lambda h: f"http://{h}/" + "/".join(str(r.randrange(10**9)) for _ in range(5)) + "?a=1&b=2"
    good = lambda h: f"http://{h}/" + "".join(r.choice("abcdefgh") for _ in range(6))
    urls = [bad("bad.info") for _ in range(150)] + [good("good.info") for _ in range(150)] + [bad("other.org") for _ in range(50)] + [good("other.org") for _ in range(50)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=[("bad.info/", "block"), ("good.info/", "allow")]).collect()
    told = {x.page_id: x.verdict for x in got if x.rule is None}
    assert len(told) == 100 and sum((v == "block") == (i < 350) for i, v in told.items()) >= 95


def test_url_trees_on_a_held_out_fold(spark):
    r = random.Random(8)
    bad = lambda h: f"http://{h}/" + "/".join(str(r.randrange(10**9)) for _ in range(5)) + "?a=1&b=2"
    good = lambda h: f"http://{h}/" + "".join(r.choice("abcdefgh") for _ in range(6))
    urls = [bad("bad.info") for _ in range(400)] + [good("good.info") for _ in range(400)]
    got = url_filter.held_out_figures(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=[("bad.info/", "block"), ("good.info/", "allow")]).first()
    assert got.urls > 100 and got.precision > 0.95 and got.recall > 0.95


def test_url_filter_query_against_plain_rules(spark):
    """Host, path, rule and the rule's verdict of every URL of the table; labelled URLs of a held-out fold are told by the trees."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in registry.QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    for p in pages:
        h, path = host_path(p.url)
        fits = [(len(x), x, v) for x, v in url_filter.RULES if (h == x.split("/")[0] or h.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule, says = max(fits)[1:] if fits else (None, None)
        assert (got[p.page_id].host, got[p.page_id].path, got[p.page_id].rule) == (h, path, rule)
        assert got[p.page_id].verdict == (says or ("block" if got[p.page_id].score >= url_filter.THRESHOLD else "allow"))


def test_url_trees_know_rare_suffixes(spark):
    """Ten suffixes with less than a thousandth of the labelled URLs each; nothing but the suffix tells the verdict."""
    r = random.Random(6)
    url = lambda h: f"http://{h}/" + "".join(r.choice("abcdefgh") for _ in range(10))
    urls = [url(h) for h in ("bad.info", "gud.info") for _ in range(2800)] + [url(f"lab.s{k}") for k in range(10) for _ in range(5)]
    rules = [("bad.info/", "block"), ("gud.info/", "allow"), *[(f"lab.s{k}/", "block" if k % 2 else "allow") for k in range(10)]]
    asked = len(urls)
    urls += [url(f"oth.s{k}") for k in range(10) for _ in range(4)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    told = {x.page_id - asked: x.verdict for x in got if x.rule is None}
    assert len(told) == 40 and sum((v == "block") == (i // 4 % 2 == 1) for i, v in told.items()) == 40


def test_chat_format(spark):
    rows = [(1, 0, "user", "<|im_end|> <\\|x"), (1, 1, "assistant", None), (1, 2, "assistant", "<|im_start|>user\nhi<|im_end|>\n"), (2, 0, None, "é🙂"), (None, 0, "assistant", "x"), (3, 0, "a\\n\nb<|", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("c", F.lit(0))
    got = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: chat_format.parse_chat(r.formatted) for c, r in got.items()} == want
    spans = got[1].loss_spans
    assert [chat_format.unescape(got[1].formatted[a:e]) for a, e in zip(spans[::2], spans[1::2], strict=True)] == ["", rows[2][3]]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_pipeline_stages_pass_foreign_columns_and_odd_rows(spark):
    import corpus_pipeline

    texts = [*TEXTS, *["ein langer Satz über Wörter und Sachen %d" % (i % 3) for i in range(30)]]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = documents(spark, texts, ids).withColumn("lang", F.lit("de"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(r.score, r.kept, r["a.b"]) for r in out.collect()} <= {("clash", "clash", "clash")}, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(texts)


def test_pipeline_stages_of_texts_of_few_bytes(spark):
    import corpus_pipeline

    texts = ["A.", "le", "é", "x", "A.", "zu", "b", "", None]
    docs = documents(spark, texts, [0, *range(7, 15)]).withColumn("lang", F.lit("de"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).count() <= len(texts), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(texts)
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert sorted(r.text for r in kept.collect()) == ["A.", "A.", "le", "zu", "é"]  # a single letter has no subword


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    stage = {r.doc_id: r.text for r in langid.identify(docs, model).where("accepted").collect()}
    norm = {}
    for i in sorted(stage):
        key = "".join(" " if c in " \t\n\v\f\r" else c for c in stage[i])
        while "  " in key:
            key = key.replace("  ", " ")
        norm.setdefault(key, i)
    kept = sorted(norm.values())
    ids = component_ids(shingle_sets([stage[i] for i in kept]))
    kept = [kept[k] for k in range(len(kept)) if ids[k] == k]
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(kept))).where("kept")
    want = {r.doc_id: hashlib.sha256(stage[r.doc_id].encode()).hexdigest() for r in mixed.collect()}
    assert {r.doc_id: r.text_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert len(corpus_pipeline.STAGES) == 5
