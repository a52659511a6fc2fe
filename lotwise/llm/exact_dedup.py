"""Exact dedup with a log-structured merge index of text digests.

Tasks fill memtables, which keep a digest once with its smallest id and its count, and flush them as sorted runs, cut
by ranges of the digest. Compaction merges the runs of a range level by level. Its answers return to the runs, so that
a text of which a third of all rows are copies is one entry for each run and never a key under which its rows meet.
Hits are verified by bytes: copies within a memtable there, and the first copies of the runs by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_word, chunk, filter_words, narrow_batches, only, packed, written

#: Rows and bytes of text of a memtable; when it is full it is flushed as a sorted run.
MEMTABLE_ROWS, MEMTABLE_BYTES = 200_000, 32 << 20
#: Rows of a range of digests (about; digests are spread evenly), and runs that one step of compaction merges.
RANGE_ROWS, FAN_IN = 1_000_000, 16
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
_RUN = "run long, range int, keys binary, low array<long>, n array<long>, torn binary, ids array<long>, shas binary, place binary"


def normalised(text: Column) -> Column:
    """Each run of space, tab, LF, VT, FF or CR becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _smallest(low: np.ndarray, null: np.ndarray, at: np.ndarray) -> pa.Array:
    """The smallest id of each group that begins at ``at``; null where all are."""
    value = np.minimum.reduceat(np.where(null, np.iinfo(np.int64).max, low), at)
    return pa.array(value, mask=np.logical_and.reduceat(null, at))


def _longs(column) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.fill_null(0), np.int64), np.asarray(flat.is_null())


def flush_runs(rows: DataFrame, width: int, ranges: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(id, text, sha) rows to sorted runs, a row for each run and range of digests.

    keys: the distinct digests in order (``width`` bytes of each sha), low and n: smallest id and count of each, torn:
    whether its texts differ (a collision). ids, shas and place: the rows themselves with the number of their key.
    """

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush():
            t = pa.Table.from_batches(held)
            ids, null = _longs(t.column(0))
            shas = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(-1, 32)
            keys = np.ascontiguousarray(shas[:, :width]).view(f"V{width}").ravel()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            at = np.flatnonzero(new)
            place = np.cumsum(new) - 1
            n = np.diff(np.append(at, len(keys)))
            # copies meet the first text of their digest
            torn = np.zeros(len(at), bool)
            copies = np.flatnonzero(~new)
            if len(copies):
                text = t.column(1).cast(pa.large_string()).combine_chunks()
                same = pc.equal(text.take(pa.array(order[copies])), text.take(pa.array(order[at[place[copies]]])))
                torn[place[copies[~np.asarray(same)]]] = True
            low = _smallest(ids[order], null[order], at)
            head = shas[order[at], 0].astype(np.int64) << 8 | (shas[order[at], 1] if width > 1 else 0)
            part = head * ranges >> 16
            cut = np.searchsorted(part, np.arange(ranges + 1))
            out = []
            for k in range(ranges):
                a, b = cut[k], cut[k + 1]
                if a < b:
                    x, y = at[a], at[b] if b < len(at) else len(keys)
                    mine = pa.array(ids[order[x:y]], mask=null[order[x:y]]).to_pylist()
                    out.append((seq, k, keys[at[a:b]].tobytes(), low[a:b].to_pylist(), n[a:b].tolist(), torn[a:b].tobytes(), mine, shas[order[x:y]].tobytes(), (place[x:y] - a).astype(np.uint32).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["run", "range", "keys", "low", "n", "torn", "ids", "shas", "place"])

        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.column(1).nbytes
            if rows >= memtable_rows or size >= MEMTABLE_BYTES:
                yield flush()
                held, rows, size, seq = [], 0, 0, seq + 1
        if rows:
            yield flush()

    return rows.select("id", "text", "sha").mapInArrow(memtables, _RUN)


def compact(runs: DataFrame, width: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the runs of each range, ``fan_in`` at a time, until one is left: range, keys, low, n, torn, and runs, the number of runs that hold a key.

    A merge keeps the smallest id and sums the counts. Runs hold a digest once, so a frequent text weighs no more than
    a rare one.
    """

    def merge(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), f"V{width}")
        low, null = _longs(table.column("low").combine_chunks().flatten())
        n, _ = _longs(table.column("n").combine_chunks().flatten())
        runs, _ = _longs(table.column("runs").combine_chunks().flatten())
        torn = np.frombuffer(b"".join(table.column("torn").to_pylist()), bool)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        one = lambda x, t: pa.array([x], t)
        longs = pa.list_(pa.int64())
        return pa.table({"range": table.column("range")[:1], "keys": one(keys[at].tobytes(), pa.binary()), "low": one(_smallest(low[order], null[order], at).to_pylist(), longs), "n": one(np.add.reduceat(n[order], at), longs), "torn": one(np.logical_or.reduceat(torn[order], at).tobytes(), pa.binary()), "runs": one(np.add.reduceat(runs[order], at), longs), "run": table.column("run")[:1]})

    level = runs.select("range", "keys", "low", "n", "torn", F.transform("n", lambda x: F.lit(1).cast("long")).alias("runs"), F.dense_rank().over(_by_run()).cast("long").alias("run"))
    most = runs.groupBy("range").count().agg(F.max("count")).first()[0] or 0
    while True:
        level = level.withColumn("run", F.floor((F.col("run") - 1) / fan_in).cast("long")).groupBy("range", "run").applyInArrow(merge, "range int, keys binary, low array<long>, n array<long>, torn binary, runs array<long>, run long")
        most = -(-most // fan_in)
        if most <= 1:
            return written(level.drop("run"), "index")
        level = written(level.withColumn("run", F.col("run") + 1), "level")


def _by_run():
    from pyspark.sql import Window

    return Window.partitionBy("range").orderBy("run")


def answered(docs: DataFrame, id_col: str, text_col: str, digest_bits: int = 256, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """id, sha, keep_id and n of every row of docs: a written table without texts."""
    narrow_batches(docs.sparkSession)
    width = max(1, digest_bits // 8)
    text = normalised(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    ranges = min(1 << 16 if width > 1 else 256, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS)))
    runs = written(flush_runs(rows, width, ranges, memtable_rows), "runs")
    index = compact(runs, width, fan_in)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """The index's word on each key of a range's runs: a run has a digest once, so a frequent text weighs no more here than a rare one."""
        keys = np.frombuffer(b"".join(right.column("keys").to_pylist()), f"V{width}")
        low, null = _longs(right.column("low").combine_chunks().flatten())
        n, _ = _longs(right.column("n").combine_chunks().flatten())
        many, _ = _longs(right.column("runs").combine_chunks().flatten())
        torn = np.frombuffer(b"".join(right.column("torn").to_pylist()), bool)
        at = [np.searchsorted(keys, np.frombuffer(mine, f"V{width}")) for mine in left.column("keys").to_pylist()]
        longs = pa.list_(pa.int64())
        return pa.table({"run": left.column("run"), "range": left.column("range"), "all_low": pa.array([pa.array(low[x], mask=null[x]).to_pylist() for x in at], longs), "all_n": pa.array([n[x].tolist() for x in at], longs), "repeats": pa.array([(many[x] > 1).tobytes() for x in at], pa.binary()), "any_torn": pa.array([torn[x].tobytes() for x in at], pa.binary())})

    told = runs.select("run", "range", "keys").groupBy("range").cogroup(index.groupBy("range")).applyInArrow(answer, "run long, range int, all_low array<long>, all_n array<long>, repeats binary, any_torn binary")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a run and range, with the word on their keys; the first row of a digest in each run says whether its text has to be verified."""
        for b in batches:
            all_ids = chunk(b.column(0))
            cut = np.asarray(all_ids.offsets).tolist()
            for k, (shas, place, first, low, n, repeats, torn) in enumerate(zip(*[b.column(c).to_pylist() for c in range(1, b.num_columns)], strict=True)):
                key = pa.array(np.frombuffer(place, np.uint32))
                own = all_ids.values[cut[k] : cut[k + 1]]
                of = lambda values: pa.array(values, pa.int64()).take(key)  # noqa: B023, E731
                flag = lambda raw: np.frombuffer(raw, bool)[key.to_numpy()]  # noqa: B023, E731
                lead = np.asarray(pc.equal(own, of(first)).fill_null(True))
                sha = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(own), [None, pa.py_buffer(shas)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([own, sha, of(low), of(n), pa.array(lead & flag(repeats)), pa.array(flag(torn))], names=["id", "sha", "keep_id", "n", "ask", "torn"])

    back = runs.join(told, ["run", "range"]).select("ids", "shas", "place", "low", "all_low", "all_n", "repeats", "any_torn")
    told = written(back.mapInArrow(rows_of, "id long, sha binary, keep_id long, n long, ask boolean, torn boolean"), "told")

    # the first copies of the runs meet by digest; of each digest a task hands on its least and greatest text
    ask = written(told.where("ask").select("id").distinct(), "ask")
    key = F.substring("sha", 1, width)
    same = only(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", ask)
    same = same.withColumn("text", normalised(F.col("text").cast("string"))).withColumn("sha", F.unhex(F.sha2("text", 256)))
    wrong = same.groupBy(key.alias("_k")).agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("_k")
    wrong = written(wrong.union(told.where("torn").select(key.alias("_k"))).distinct(), "collisions")
    if wrong.isEmpty():
        return told.select("id", "sha", "keep_id", "n")
    # digests that hold different texts: those are told apart by the texts
    good = told.join(wrong, key == F.col("_k"), "left_anti").select("id", "sha", "keep_id", "n")
    torn = rows.join(wrong, key == F.col("_k"), "left_semi")
    exact = torn.groupBy(F.col("text").alias("_t")).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    return written(good.unionByName(torn.join(exact, F.col("text") == F.col("_t")).select("id", "sha", "keep_id", "n")), "told")


def _attached(docs: DataFrame, told: DataFrame, id_col: str, text_col: str, but: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (_row, _id, _sha), those that no filter lets pass and those that do; rows meet by id and digest."""
    rows = docs.select(packed(docs, but).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    words = filter_words(told.count())
    word, mask = bloom_word(F.col("_id"), words)
    seen = F.broadcast(bloom(told, F.col("id"), words).withColumnsRenamed({"word": "_w", "bits": "_bits"}))  # bounded: see FILTER_WORDS
    rows = rows.withColumns({"_word": word, "_mask": mask}).join(seen, F.col("_word") == F.col("_w"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    sha = F.unhex(F.sha2(normalised(F.col("_text")), 256))
    part = lambda ok: rows.where(ok).select("_row", "_id", sha.alias("_sha"))
    return part(~maybe), part(maybe)


_HOW = "(_id <=> id) AND _sha = sha"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when their normalised bytes are. Of equal texts the row with the smallest id stays; a null id
    is larger than any other, and keep_id is null only where all ids of the group are. Repeated rows (same id and
    text) all count in group_size and all have kept true if their id is the smallest. Null text counts as empty.
    An empty table gives an empty result. Other columns of docs pass through; one named like a result column is
    replaced. ``digest_bits`` shortens the index's digests (for tests): hits are verified by the texts' bytes, so
    that a collision never joins two texts. A row is held in memory with its text; a memtable holds one row more than
    its bounds at most.
    """
    told = answered(docs, id_col, text_col, digest_bits, memtable_rows, fan_in).where("n > 1").distinct()
    alone, met = _attached(docs, told, id_col, text_col, RESULT)
    own = [F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")]
    met = met.join(told.withColumn("_hit", F.lit(True)), F.expr(_HOW), "left")
    keep = F.when(F.col("_hit"), F.col("keep_id")).otherwise(F.col("_id"))
    found = [keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")]
    return alone.select("_row.*", *own).unionByName(met.select("_row.*", *found))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay (see ``exact_dedup``), with all their columns as they are."""
    gone = answered(docs, id_col, text_col).where("not (id <=> keep_id)").distinct()
    alone, met = _attached(docs, gone, id_col, text_col, ())
    return alone.select("_row.*").unionByName(met.join(gone, F.expr(_HOW), "left_anti").select("_row.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    told = answered(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return told.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
