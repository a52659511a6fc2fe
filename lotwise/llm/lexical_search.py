"""Ranked lexical search: the best documents of each item, by a threshold-seeded join.

A document's score for an item sums the impacts of the item's terms in it. The k-th largest impact of each term over
all documents is stored: as k documents reach it, the item's k-th score is no less than that of any of its terms (the
seed of its threshold). An item's terms are ordered by their largest possible impact, and ``rest`` is what the terms
after one can add at most. A posting can only start a candidate if its own impact and the rest reach the threshold;
terms for which no posting can are left out altogether. The first term of the item that a document holds always has
enough if the document's score reaches the threshold, so no result is lost. Candidates are rescored exactly, and the
k-th of a task's own scores raises its thresholds as it goes.

Items meet the documents in blocks of a bounded number of (item, term) slots; each block reads the table of postings,
not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, chunk, narrow_batches, written

K = 20
#: (Item, term) slots of a block of items, bytes of terms up to which the items' terms are handed to the tasks that
#: read the texts (beyond it the terms of all texts are kept as postings), and pairs that a task expands at a time.
BLOCK_SLOTS, VOCABULARY_BYTES, PAIRS = 1 << 19, 16 << 20, 1 << 21
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ROW = "id long, n long, terms array<string>, tfs array<long>"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts on end, and the number of them in each text; terms never cross texts."""
    data, off = buffers(texts)
    word = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1] if len(data) else word
    start = np.flatnonzero(word & ~before)
    held = np.concatenate([[0], np.cumsum(word)])  # word bytes before each byte
    at = np.append(held[start], held[-1]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(LOWER[data[word]]))
    return flat, np.diff(np.searchsorted(start, off))


def term_counts(rows: DataFrame, id_col: str, text_col: str, vocabulary: pa.Array | None = None) -> DataFrame:
    """Per row with a term: id, n (terms with repeats), terms (those of the vocabulary, distinct) and tfs."""
    narrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = terms_of(chunk(b.column(1)))
            told = flat.dictionary_encode()
            known, code = told.dictionary, np.asarray(told.indices).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            if vocabulary is not None:
                keep = np.asarray(pc.is_in(known, value_set=vocabulary))[code] if len(code) else np.zeros(0, bool)
                row, code = row[keep], code[keep]
            pair, tf = np.unique(row * max(1, len(known)) + code, return_counts=True)
            row, code = np.divmod(pair, max(1, len(known)))
            some = np.flatnonzero(n)
            off = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
            terms = known.take(pa.array(code)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(n[some]), pa.ListArray.from_arrays(off, terms), pa.ListArray.from_arrays(off, pa.array(tf))], names=["id", "n", "terms", "tfs"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").mapInArrow(run, ROW)


def postings(docs: DataFrame) -> DataFrame:
    return docs.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def term_statistics(docs: DataFrame, count: int, total: int, k: int = K) -> DataFrame:
    """Per term: weight, its largest rating and its k-th (0 where fewer documents hold it). Impact is weight x rating.

    Only the k largest ratings of each partition are shuffled (a window with a limit).
    """
    rated = postings(docs).select("term", F.expr(rating_sql(count, total)).alias("rating"))
    best = rated.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("rating")))).where(F.col("k") <= k)
    kth = best.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("k") == k, F.col("rating"))), F.lit(0).cast("long")).alias("kth"), F.max("rating").alias("top"))
    df = rated.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * count) + 2) / (2 * F.col("df") + 1)))
    return df.join(kth, F.col("t") == F.col("term")).select("term", weight.alias("weight"), "top", "kth")


def rating_sql(count: int, total: int, tf: str = "tf", n: str = "n") -> str:
    return f"(1000000000L * {tf}) div (1000L * {tf} + 12L * (75L + (25L * {n} * {count}L) div {total}L))"


def slots(items: DataFrame, statistics: DataFrame) -> DataFrame:
    """(Item, term) slots: repeats, weight, rest (the most that later terms add) and seed (the item's first threshold)."""
    flat = items.select("item", "item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item", "item_id", F.col("x.terms").alias("t"), F.col("x.tfs").alias("repeats"))
    met = flat.join(statistics, F.col("t") == F.col("term")).withColumn("most", F.col("repeats") * F.col("weight") * F.col("top"))
    own = Window.partitionBy("item")
    rest = F.coalesce(F.sum("most").over(own.orderBy(F.desc("most"), "term").rowsBetween(1, Window.unboundedFollowing)), F.lit(0).cast("long"))
    return met.select("item", "item_id", "term", "repeats", "weight", "most", rest.alias("rest"), F.max(F.col("repeats") * F.col("weight") * F.col("kth")).over(own).alias("seed"))


def _ranges(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths, on end."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Block:
    """The slots of a block of items, and the best documents that a task has met so far."""

    def __init__(self, rows: list, k: int):
        keys = sorted({r["item"] for r in rows})
        number = {key: i for i, key in enumerate(keys)}
        self.k, self.ids = k, [None] * len(keys)
        self.words = sorted({r["term"] for r in rows})
        place = {w: i for i, w in enumerate(self.words)}
        rows = sorted(rows, key=lambda r: (number[r["item"]], place[r["term"]]))
        self.item = np.array([number[r["item"]] for r in rows], np.int64)
        self.term = np.array([place[r["term"]] for r in rows], np.int64)
        self.gain, self.most, self.rest = (np.array(v, np.int64) for v in zip(*[(r["repeats"] * r["weight"], r["most"], r["rest"]) for r in rows], strict=True))
        self.threshold = np.zeros(len(keys), np.int64)
        for r in rows:
            self.ids[number[r["item"]]] = r["item_id"]
            self.threshold[number[r["item"]]] = r["seed"]
        self.first = np.searchsorted(self.item, np.arange(len(keys) + 1))
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # item, score, id, null id
        self.candidates = 0

    def ready(self) -> None:
        """In a task: the terms as an Arrow array."""
        self.value_set = pa.array(self.words, pa.string())

    def meet(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, lists: pa.ListArray, tfs: np.ndarray, count: int, total: int) -> None:
        sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        found = pc.index_in(lists.flatten(), value_set=self.value_set).fill_null(-1)
        term = np.asarray(found).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        hit = term >= 0
        term, doc, tf = term[hit], doc[hit], tfs[hit]
        rating = (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n[doc] * count) // total))
        order = np.argsort(doc * len(self.words) + term)
        term, doc, rating = term[order], doc[order], rating[order]
        # terms of which no posting can start a candidate are out
        alive = np.flatnonzero(self.most + self.rest >= self.threshold[self.item])
        by_term = alive[np.argsort(self.term[alive], kind="stable")]
        start = np.searchsorted(self.term[by_term], np.arange(len(self.words) + 1))
        width = np.diff(start)[term]
        done = np.cumsum(width)
        a = 0
        while a < len(doc):
            b = max(int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")), a + 1)
            b = int(np.searchsorted(doc, doc[b - 1], "right"))  # whole documents
            slot = by_term[np.repeat(start[term[a:b]], width[a:b]) + _ranges(width[a:b])]
            post = np.repeat(np.arange(a, b), width[a:b])
            ok = self.gain[slot] * rating[post] + self.rest[slot] >= self.threshold[self.item[slot]]
            pair = np.unique(doc[post[ok]] * len(self.ids) + self.item[slot[ok]])
            for x in range(0, len(pair), PAIRS // 64):
                self._rescore(pair[x : x + PAIRS // 64], term[a:b], doc[a:b], rating[a:b], ids, null)
            a = b

    def _rescore(self, pair: np.ndarray, term: np.ndarray, doc: np.ndarray, rating: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.candidates += len(pair)
        row, item = np.divmod(pair, len(self.ids))
        width = self.first[item + 1] - self.first[item]
        slot = np.repeat(self.first[item], width) + _ranges(width)
        key, asked = doc * len(self.words) + term, np.repeat(row, width) * len(self.words) + self.term[slot]
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        impact = np.where(key[at] == asked, self.gain[slot] * rating[at], 0)
        score = np.add.reduceat(impact, np.cumsum(width) - width)
        keep = (score > 0) & (score >= self.threshold[item])
        new = (item[keep], score[keep], ids[row[keep]], null[row[keep]])
        item, score, own, none = (np.concatenate(x) for x in zip(self.best, new, strict=True))
        order = np.lexsort((own, none, -score, item))
        item, score, own, none = item[order], score[order], own[order], none[order]
        rank = _ranges(np.diff(np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item)))) if len(item) else item
        last = rank == self.k - 1
        np.maximum.at(self.threshold, item[last], score[last])
        top = rank < self.k
        self.best = (item[top], score[top], own[top], none[top])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, block_slots: int = BLOCK_SLOTS, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """The k documents with the highest score above 0 of each item: item, rank, document, score.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased; null and empty texts have
    none, on either side. Equal scores rank by ascending id, null ids last. Repeated rows of docs rank each on their
    own. Repeated rows of items with the same id and the same terms are one item; with other terms each has its own
    ranks under the shared id. An empty table on either side gives an empty result; other columns are not read. A text
    is held in memory whole, with some 20 bytes for each of its bytes.
    """
    spark = docs.sparkSession
    asked = term_counts(items, item_col, item_text_col)
    asked = written(asked.select(F.md5(F.to_json(F.struct("id", F.array_sort(F.arrays_zip("terms", "tfs"))), {"ignoreNullFields": "false"})).alias("item"), F.col("id").alias("item_id"), "terms", "tfs").dropDuplicates(["item"]), "items")
    words = asked.select(F.explode("terms").alias("term")).distinct()
    size = words.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    vocabulary = pa.array([r["term"] for r in words.collect()], pa.large_string()) if size <= vocabulary_bytes else None
    counted = written(term_counts(docs, id_col, text_col, vocabulary), "postings")
    row = counted.agg(F.count("*").alias("count"), F.sum("n").alias("total")).first()
    count, total = row["count"], row["total"] or 1
    known = written(slots(asked, term_statistics(counted, count, total, k)), "slots")
    blocks = -(-known.count() // block_slots)
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))
    best = None
    for b in range(blocks):
        found = _block(counted, Block(known.where(block == b).collect(), k), count, total) if blocks == 1 or not known.where(block == b).isEmpty() else None
        best = found if best is None else best if found is None else best.unionByName(found.withColumn("item", F.concat(F.lit(f"{b}:"), "item")))
    if best is None:
        best = spark.createDataFrame([], _FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


_FOUND = "item string, item_id long, doc long, score long"


def _block(counted: DataFrame, held: Block, count: int, total: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.ready()
        for b in batches:
            ids = chunk(b.column(0))
            held.meet(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(b.column(1)), chunk(b.column(2)), np.asarray(chunk(b.column(3)).flatten()), count, total)
        item, score, own, none = held.best
        yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in item.tolist()], pa.string()), pa.array([held.ids[i] for i in item.tolist()], pa.int64()), pa.array(own, pa.int64(), mask=none), pa.array(score, pa.int64())], names=["item", "item_id", "doc", "score"])

    return counted.mapInArrow(run, _FOUND)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term),
t AS (SELECT item_id, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM t WHERE score > 0 QUALIFY rank <= 20
"""
