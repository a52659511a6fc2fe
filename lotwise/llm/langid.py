"""Language identification: averaged hashed subword embeddings, a linear softmax trained by SGD in numpy, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunk, narrow_batches, packed, spans, written

#: Subwords are byte n-grams of these orders over lower-cased text in which all but letters is a blank.
ORDERS, BITS, DIM = (2, 3, 4), 16, 16
#: Bounds of the sample that the model is fitted on: documents of a language, and languages (the most frequent).
PER_LANGUAGE, LANGUAGES = 400, 200
#: Features (bucket and share of a text, 8 bytes each) that the driver holds, at most: the first texts of every language,
#: then the second ones, and so on, as far as they fit.
FEATURES = 32 << 20
EPOCHS, RATE, BATCH_DOCS, SEED = 30, 2.0, 32, 5
#: Share of documents of known language that may be rejected, and the most that a threshold may ask for.
REJECT_SHARE, MOST = 0.001, 0.5
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
CHUNK = 1 << 20


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # (2**BITS, DIM)
    weight: np.ndarray  # (DIM, languages)
    bias: np.ndarray
    heat: float = 1.0  # temperature that calibrates the softmax
    threshold: float = 0.0
    known: np.ndarray | None = None  # buckets that the fitted texts have; all without
    cover: float = 0.0  # least share of a text's subwords in known buckets

    def probabilities(self, mean: np.ndarray, projected: bool = True) -> np.ndarray:
        z = ((mean if projected else mean @ self.weight) + self.bias) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def subwords(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of the n-gram at each byte, and whether it lies in one text and is not blank."""
    x = _FOLD[data].astype(np.uint32)
    n = len(x)
    ends = np.zeros(n, bool)  # the last byte of each text
    ends[off[1:][np.diff(off) > 0] - 1] = True
    blank = x == 0x20
    whole, empty = np.ones(n, bool), blank.copy()
    h = x * _MULT[0]
    for k in range(1, max(ORDERS)):
        m = max(0, n - k)  # a negative end would count from the back
        whole[:m] &= ~ends[k - 1 : k - 1 + m]
        whole[m:] = False
        empty[:m] &= blank[k:]
        h[:m] += (x[k:] + np.uint32(k)) * _MULT[k]
        if k + 1 in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), whole & ~empty


def predict_arrays(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its calibrated probability for each text (-1 and 0 where there is no subword)."""
    return measured(model, texts)[:2]


def measured(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``predict_arrays``, and the share of each text's subwords that lie in buckets of the fitted texts."""
    data, off = buffers(texts)
    table = (model.embed @ model.weight if len(model.langs) <= DIM else model.embed).T.astype(np.float32).copy()
    best, score, cover = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts))
    for i, j in spans(off, CHUNK):
        part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
        rows = np.flatnonzero(np.diff(cut) > 0)
        if not len(rows):
            continue
        sums, count, seen = np.zeros((len(table), len(rows))), np.zeros(len(rows)), np.zeros(len(rows))
        for bucket, ok in subwords(part, cut):
            count += np.add.reduceat(ok.astype(np.int64), cut[rows])
            if model.known is not None:
                seen += np.add.reduceat((model.known[bucket] & ok).astype(np.int64), cut[rows])
            for c in range(len(table)):
                v = table[c][bucket]
                v *= ok
                sums[c] += np.add.reduceat(v, cut[rows], dtype=np.float64)
        has = count > 0
        p = model.probabilities(sums.T[has] / count[has][:, None], len(model.langs) <= DIM)
        at = i + rows[has]
        best[at], score[at] = p.argmax(axis=1), p.max(axis=1)
        if model.known is not None:
            cover[at] = seen[has] / count[has]
    return best, score, cover


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = SEED) -> Model | None:
    """Fit on (language, buckets, shares) rows; every fifth row calibrates. None without rows."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({s[0] for s in samples})
    y = np.array([langs.index(s[0]) for s in samples])
    order = rng.permutation(len(samples))
    held = order[::5] if len(samples) >= 10 * len(langs) else order[:0]
    used = np.setdiff1d(order, held)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(used), max(1, len(used) // BATCH_DOCS)):
            mean = np.stack([samples[k][2] @ embed[samples[k][1]] for k in at])
            z = mean @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ weight.T
            weight -= rate * mean.T @ p
            bias -= rate * p.sum(axis=0)
            for g, k in zip(back, at, strict=True):  # each text's buckets are distinct
                embed[samples[k][1]] -= rate * 20 * samples[k][2][:, None] * g
    model = Model(langs, embed.astype(np.float32), weight, bias)
    test = held if len(held) else used
    mean = np.stack([samples[k][2] @ model.embed[samples[k][1]] for k in test])
    loss = {}
    for heat in np.geomspace(0.25, 8, 41):
        model.heat = heat
        loss[heat] = -np.log(np.maximum(model.probabilities(mean, False)[np.arange(len(test)), y[test]], 1e-12)).mean()
    model.heat = min(loss, key=loss.get)
    model.threshold = float(min(MOST, np.quantile(model.probabilities(mean, False).max(axis=1), REJECT_SHARE)))
    # a softmax is sure of texts in letters that it never saw; their subwords are not those of the fitted texts
    model.known = np.zeros(1 << BITS, bool)
    for k in used:
        model.known[samples[k][1]] = True
    model.cover = float(min(MOST, np.quantile([samples[k][2][model.known[samples[k][1]]].sum() for k in test], REJECT_SHARE)))
    return model


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from the documents that are not held out and have a language: a sample by hash of at most
    ``per_language`` for each of the LANGUAGES most frequent languages, whole texts each, within FEATURES. Null without
    any."""
    spark = docs.sparkSession
    narrow_batches(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(F.col(id_col)), F.lit(False)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)).alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    rate = F.lit(-1.0)
    for r in counts:  # about half as many more than are asked for, then the smallest hashes of those
        rate = F.when(F.col("lang") == r["lang"], 1.5 * (per_language + 50) / r["count"]).otherwise(rate)
    near = rows.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < rate).groupBy("h", "lang").agg(F.min("text").alias("text"))  # of rows that repeat an id the same text, always
    near = near.withColumn("k", F.xxhash64("h"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            langs, keys = b.column(0).to_pylist(), b.column(2).to_pylist()
            out = []
            for i, lang in enumerate(langs):
                counted = np.zeros(1 << BITS)
                part = data[off[i] : off[i + 1]]
                if len(part):
                    for bucket, ok in subwords(part, np.array([0, len(part)])):
                        counted += np.bincount(bucket[ok], minlength=1 << BITS)
                at = np.flatnonzero(counted)
                if len(at):
                    out.append((lang, keys[i], at.astype(np.int32), (counted[at] / counted.sum()).astype(np.float32)))
            if out:
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "k", "at", "share"])

    from pyspark.sql import Window

    top = near.select("lang", "text", "k").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).where(F.col("_n") <= per_language).select("lang", "text", "k")
    found = written(top.mapInArrow(features, "lang string, k long, at array<int>, share array<float>"), "features")
    # per_language x LANGUAGES rows at most: their sizes, added up in rounds over the languages
    sizes = found.select("lang", "k", F.size("at").alias("size")).withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("k")))
    fits = sizes.withColumn("sum", F.sum("size").over(Window.orderBy("_n", "lang"))).where(F.col("sum") <= FEATURES).select("lang", "k")
    got = found.join(F.broadcast(fits), ["lang", "k"]).toArrow()  # bounded rows
    langs, keys = got.column(0).to_pylist(), got.column(1).to_pylist()
    at, share = chunk(got.column(2)), chunk(got.column(3))
    cut = np.concatenate([[0], np.cumsum(np.asarray(at.value_lengths(), np.int64))]) if len(langs) else [0]
    at, share = np.asarray(at.flatten()), np.asarray(share.flatten())  # both lists of a row are as long
    order = sorted(range(len(langs)), key=lambda i: (langs[i], keys[i]))
    return train([(langs[i], at[cut[i] : cut[i + 1]], share[cut[i] : cut[i + 1]]) for i in order])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted, from the whole text alone.

    Null texts and texts without a letter get ``und``, score 0, not accepted; so does every text if there is no model.
    ``accepted`` is false as well where the calibrated probability is below the model's threshold, or where fewer of the
    subwords than its ``cover`` are in buckets of the fitted texts, as in letters of no language that it knows. Columns
    of docs with one of the three names are replaced, others pass through. Empty tables give empty results, repeated
    rows the same. A text is read whole, some megabytes at a time; a very long one is one value in memory.
    """
    return told(docs, model, text_col, ("lang_pred", "score", "accepted")).select("_row.*", "lang_pred", "score", "accepted")


def accepted_rows(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs of which the language is accepted (see ``identify``), with all their columns as they are."""
    return told(docs, model, text_col, ()).where("accepted").select("_row.*")


def told(docs: DataFrame, model: Model | None, text_col: str, but: tuple[str, ...]) -> DataFrame:
    """_row (the columns of docs but those named), lang_pred, score and accepted."""
    narrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS x DIM floats and LANGUAGES columns

    @F.pandas_udf("lang string, score double, accepted boolean")
    def tell(texts):
        import pandas as pd

        m = shared.value
        arr = pa.array(texts, pa.large_string(), from_pandas=True)
        if m is None or not len(arr):
            return pd.DataFrame({"lang": [UNKNOWN] * len(arr), "score": np.zeros(len(arr)), "accepted": np.zeros(len(arr), bool)})
        best, score, cover = measured(m, arr)
        prior = int(np.argmax(m.bias))  # letters, but no subword: a single letter
        names = np.array(m.langs, object)
        return pd.DataFrame({"lang": names[np.where(best < 0, prior, best)], "score": np.where(best < 0, 1 / len(names), score), "accepted": (score >= max(m.threshold, 1e-9)) & (cover >= m.cover)})

    text = F.col(f"`{text_col}`")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(packed(docs, but).alias("_row"), tell(text).alias("_told"), letters.alias("_letters"))
    return rows.select("_row", F.when(F.col("_letters"), F.col("_told.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("_letters"), F.col("_told.score")).otherwise(0.0).alias("score"), (F.col("_letters") & F.col("_told.accepted")).alias("accepted"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
