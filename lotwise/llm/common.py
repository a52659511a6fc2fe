"""Shared folder, row batches, hashing and a distributed hash count for the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text per batch row; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Fixed random tables, the same in every task.
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own (single machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("lotwise.shared.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lotwise-")
        spark.conf.set("lotwise.shared.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lotwise-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    out = df.write.option("compression", codec)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of text whose hashes meet in one fragment, at most (about; hashes are spread evenly).
FRAGMENT_BYTES = 128 << 20


def fragments(docs: DataFrame, text_col: str) -> int:
    """Fragments of a hash range: as many as keep one within FRAGMENT_BYTES of text, and no fewer than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT_BYTES))


def narrow_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows, and a row here may hold megabytes of text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


#: 64-bit words of a Bloom filter: about one for six keys, between these bounds (16 KiB and 32 MiB of bits). Beyond some
#: 25 million keys it fills, and lets more rows into the shuffle that follows; none is lost.
FILTER_WORDS = (1 << 11, 1 << 22)


def filter_words(keys: int) -> int:
    return min(max(1 << (keys // 6).bit_length(), FILTER_WORDS[0]), FILTER_WORDS[1])


def bloom_word(key: Column, words: int) -> tuple[Column, Column]:
    """Place and bit mask of a key in a blocked Bloom filter: three bits of one 64-bit word."""
    h = F.xxhash64(key)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, k), F.lit(64)).cast("int"))
    return F.pmod(h, F.lit(words)), bit(26).bitwiseOR(bit(39)).bitwiseOR(bit(52))


def bloom(keys: DataFrame, key: Column, words: int) -> DataFrame:
    """Blocked Bloom filter over the keys: at most ``words`` rows of (word, bits)."""
    word, mask = bloom_word(key, words)
    return keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))


def packed(rows: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """A row's columns as one, so that no column of ours can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in but])


def _filtered(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows as _row, _key and _maybe: whether the bounded filter over ``ids`` (a written table) lets the id pass."""
    told = rows.select(packed(rows).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_key"))
    words = filter_words(ids.count())
    word, mask = bloom_word(F.col("_key"), words)
    seen = F.broadcast(bloom(ids, F.col("id"), words).withColumnsRenamed({"word": "_w", "bits": "_bits"}))  # bounded: see FILTER_WORDS
    told = told.withColumns({"_word": word, "_mask": mask}).join(seen, F.col("_word") == F.col("_w"), "left")
    return told.select("_row", "_key", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)).alias("_maybe"))


def only(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (column id). A bounded filter is broadcast first, so that most others stay out of the shuffle."""
    near = _filtered(rows, id_col, ids).where("_maybe")
    return near.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("_key").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")


def without(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not in ``ids`` (column id). Rows that the bounded filter clears are not shuffled."""
    told = _filtered(rows, id_col, ids)
    held = told.where("_maybe").join(ids.select(F.col("id").alias("_id")).distinct(), F.col("_key").eqNullSafe(F.col("_id")), "left_anti")
    return told.where("not _maybe").select("_row.*").unionByName(held.select("_row.*"))


def forest(u: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links u-w the smallest node of each one's component."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[w])
        new = root.copy()
        for at in (u, w, root[u], root[w]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def spans(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


def chunk(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; nulls have length 0."""
    n = len(arr)
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = arr.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    off = off.astype(np.int64) - int(off[0])
    if arr.null_count:  # a null may have bytes behind it
        size = np.diff(off)
        null = np.asarray(arr.is_null())
        if size[null].any():
            keep = np.repeat(~null, size)
            data, size = data[keep], np.where(null, 0, size)
            off = np.concatenate([[0], np.cumsum(size)])
    return data, off


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, b in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[i] = sum of code(b_k) * base**k over k < i; a span's hash is (C[e] - C[s]) * base**-s."""
    up, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, down = powers(len(c))
    return (c[e] - c[s]) * down[s]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) and the number of the text of each; words never cross texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data]
    white = WHITE[low]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = white[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = white[1:]
    s = np.flatnonzero(~white & (before | first[:-1]))
    e = np.flatnonzero(~white & (after | first[1:])) + 1
    return mix(span_hash(prefix_hash(low), s, e) + (e - s).astype(np.uint64)), np.searchsorted(off, s, "right") - 1


def shingles(data: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none make none."""
    h, doc = word_hashes(data, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    g = np.zeros(len(h), np.uint64)
    m = len(h) - k + 1
    if m > 0:
        for j in range(k):
            g[:m] = g[:m] * U64(0xD6E8FEB86659FD93) + h[j : j + m]
        g[:m] = mix(g[:m])
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for i, c in enumerate(n.tolist()):
        a = at[i]
        if c >= k:
            out.append(np.unique(g[a : a + c - k + 1]))
        elif c:
            x = np.array([c], np.uint64)
            for w in h[a : a + c]:
                x = x * U64(0xA0761D6478BD642F) + w
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


BATCH = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType())])


def text_batches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts packed into rows of about BATCH_BYTES, written to the shared folder, so that later passes see the same batches.

    Columns: batch (unique), ids, sizes (int64 bytes of each text), data (the UTF-8 bytes on end). Null texts count as empty.
    """
    narrow_batches(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        sizes: list[np.ndarray] = []
        parts: list[bytes] = []
        held = 0

        def flush():
            nonlocal ids, sizes, parts, held, seq
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(sizes).tobytes()], pa.binary()), pa.array([b"".join(parts)], pa.binary())],
                names=["batch", "ids", "sizes", "data"],
            )
            ids, sizes, parts, held, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            data, off = buffers(b.column(1))
            keys = b.column(0).to_pylist()
            i = 0
            while i < len(keys):
                j = int(np.searchsorted(off, off[i] + max(1, BATCH_BYTES - held), "left"))
                j = min(max(j, i + 1), len(keys))
                ids += keys[i:j]
                sizes.append(np.diff(off[i : j + 1]))
                parts.append(data[off[i] : off[j]].tobytes())
                held += int(off[j] - off[i])
                if held >= BATCH_BYTES or len(ids) >= 20_000:
                    yield flush()
                i = j
        if ids:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(pack, BATCH), "batches")


def unpack(sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]).astype(np.int64)
    return np.frombuffer(data, np.uint8), off


SLICE = "frag int, batch long, hashes binary, counts binary"


def to_byte(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 128, beyond that 121 + the logarithm to base 2, rounded up."""
    return np.where(n <= 128, n, 121 + np.ceil(np.log2(np.maximum(n, 1)))).astype(np.uint8)


def from_byte(b: np.ndarray) -> np.ndarray:
    """The count that a byte stands for: exact up to 128, beyond that the next power of two."""
    return np.where(b <= 128, b, np.exp2(np.minimum(b, 183).astype(float) - 121)).astype(np.int64)


def to_slices(batch: int, hashes: np.ndarray, counts: np.ndarray, f: int, width: int) -> Iterator[tuple]:
    """Cut the sorted distinct hashes of a batch at f even points of the hash range; ``width`` bytes of each are kept."""
    edge = [(i << 64) // f for i in range(f)]
    cut = np.searchsorted(hashes, np.array(edge, np.uint64)).tolist() + [len(hashes)]
    shift = U64(max(0, ((1 << 64) // f).bit_length() - 8 * width))
    for i in range(f):
        a, b = cut[i], cut[i + 1]
        if a < b:
            v = ((hashes[a:b] - U64(edge[i])) >> shift).astype("<u8")
            yield i, batch, v.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), to_byte(counts[a:b]).tobytes()


def global_counts(slices: DataFrame, width: int) -> DataFrame:
    """Of slices (SLICE) of each batch's hashes, how often each occurs in all batches together.

    Returns batch, counts: parts in order, one byte for each hash of the batch (see to_byte). Each fragment of
    the hash range is counted on its own; the bytes return to their batch.
    """

    def count(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table.column("hashes")]
        n = [len(x) // width for x in raw]
        wide = np.zeros((sum(n), 8), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
        keys = wide.view("<u8").reshape(-1)
        del raw, wide
        own = np.frombuffer(b"".join(x.as_py() for x in table.column("counts")), np.uint8)
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = np.flatnonzero(new)
        total = to_byte(np.add.reduceat(from_byte(own)[order], at))
        back = np.empty(len(keys), np.uint8)
        back[order] = np.repeat(total, np.diff(np.append(at, len(keys))))
        cut = np.concatenate([[0], np.cumsum(n)])
        return pa.table({"batch": table.column("batch"), "frag": table.column("frag"), "part": pa.array([back[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    parts = slices.groupBy("frag").applyInArrow(count, "batch long, frag int, part binary")
    return parts.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("frag", "part"))).alias("p")).select("batch", F.transform("p", lambda x: x["part"]).alias("counts"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) long edges: node, component (the smallest node that is reachable).

    Hooking to the smallest neighbour and pointer jumping, as joins and aggregates with a checkpoint each round;
    ends when no label changes. Nodes are those of the edges only.
    """
    shared_dir(edges.sparkSession)
    both = checkpointed(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        # the smallest label among the neighbours, then that node's own label
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        # a node's old root takes the smaller label as well
        root = step.groupBy(F.col("old").alias("p")).agg(F.min("label").alias("rl"))
        moved = step.join(jump, step.label == jump.p, "left").join(root.withColumnRenamed("p", "q"), step.label == F.col("q"), "left")
        labels = checkpointed(moved.select("node", "old", F.least("label", "pl", "rl").alias("label")))
        if labels.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
