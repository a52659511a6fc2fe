"""Paths that only large tables take, on small ones: chunks, second passes, batches, hubs, and texts of unseen languages."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import component_ids, documents, near_copies, shingle_sets

from lotwise.llm import chat_format, embedding_dedup, langid, ngram_join


def test_embedding_chunks_against_all_pairs(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(6, 24))
    x = np.concatenate([centre[k] / np.linalg.norm(centre[k]) + r.normal(size=(25, 24)) * s for k in range(6) for s in (0.02, 0.066)])  # cosines around 0.9
    x = np.concatenate([x, x[:7]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = [[j for j in range(len(x)) if j != i and float(np.dot(x[i], x[j])) / (float(np.sqrt(np.dot(x[i], x[i]))) * float(np.sqrt(np.dot(x[j], x[j])))) >= 0.9] for i in range(len(x))]
    border = np.abs(unit @ unit.T - 0.9).min()
    assert border > 1e-9 and 0 < sum(map(len, near)) < len(x) ** 2
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(x))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for chunk in (8, 16_384):
        got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.near_duplicates(table, chunk_rows=chunk).collect()}
        assert got == {i: (len(near[i]), root[i]) for i in range(len(x))}


def test_ngram_join_in_small_chunks_with_a_hub(spark, monkeypatch):
    for name, value in (("ENTRIES", 500), ("CHUNK", 20), ("PAIRS", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(7)
    base = [f"h{k}" for k in range(60)]
    star = [" ".join(base)] + [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in (r.randrange(60) for _ in range(70))]  # all near the first
    texts = near_copies(8) + star + [" ".join(["the same words in every text"] * 3) + f" {k}" for k in range(60)]
    sets = shingle_sets(texts)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in ngram_join.jaccard_join(documents(spark, texts)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, component_ids(sets), strict=True))}


def test_a_conversation_over_several_batches(spark):
    turns = 2_500
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} <|im_end|>" if t % 7 else None) for t in range(turns)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "yo")]
    random.Random(1).shuffle(rows)
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)).collect()}
    want = [("user" if t % 2 == 0 else "assistant", f"turn {t} <|im_end|>" if t % 7 else "") for t in range(turns)]
    assert chat_format.parse_chat(got[1].formatted) == want and chat_format.parse_chat(got[2].formatted) == [("user", "hi"), ("assistant", "yo")]
    spans = got[1].loss_spans
    assert [chat_format.unescape(got[1].formatted[a:e]) for a, e in zip(spans[::2], spans[1::2], strict=True)] == [t for role, t in want if role == "assistant"]


def test_texts_of_an_unseen_language(spark):
    """Fitted on the table's languages; texts in letters that none of them uses are rejected, though the softmax is sure of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = langid.fit(docs)
    known = docs.where(F.length("text") > 200)
    strange = spark.createDataFrame([(k, t * 12) for k, t in enumerate(["Это совсем другой язык, которого нет. ", "这是一种完全不同的语言。", "αυτή είναι μια άλλη γλώσσα ", "zzxq wvkj qqpy xxjw kkvz "])], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    accepted = langid.accepted_rows(known, model).count() / known.count()
    assert accepted > 0.99 and model.cover == langid.MOST and langid.accepted_rows(strange.where("doc_id < 3"), model).count() == 0
    assert all(r.lang_pred in model.langs for r in langid.identify(strange, model).collect())  # told, but not accepted
