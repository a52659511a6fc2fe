"""Vector code compression: product quantisation in whole numbers, with nearest entries found by segment-mean lower bounds.

A vector's components become integers and are cut into parts; each part is replaced by the number of its nearest entry
in that part's codebook. The nearest entry is searched coarse to fine: for a segment of b components with means m and
residual norms r, b * (m - m')**2 + (r - r')**2 is never more than the squared distance. First a part is one segment,
then it is cut into finer ones, whose bounds are summed; entries whose bound exceeds a distance that is reached are
out, and those left get their exact distance in 64-bit integers. Only the codebooks pass through the driver: their
size is fixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers beyond this (components beyond 65 536) would take distances out of 64 bits.
LARGEST = 1 << 26
#: Segments of a part at each level of the search, entries that need no finer level, and rows that are compared with a codebook at a time.
LEVELS, FEW, BLOCK_ROWS = (1, 4, 8), 4, 512
#: Bounds are computed in doubles; so much of the two norms is taken off before one may rule an entry out.
SLACK = 1e-11


def cuts(dims: int, parts: int) -> list[int]:
    return [dims * i // parts for i in range(parts + 1)]


def segments(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of integers as the points whose squared distances are the bounds: the mean of each segment times the root of its size, and its residual norm."""
    edge = cuts(x.shape[1], min(count, x.shape[1]))
    wide = x.astype(float)
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        mean = wide[:, a:b].mean(axis=1)
        out += [mean * np.sqrt(b - a), np.sqrt(((wide[:, a:b] - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def bounds(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of all rows of u and v (both by ``segments``), less what rounding may add."""
    norm = lambda p: (p * p).sum(axis=1, keepdims=True) * (1 - SLACK) - SLACK
    one = lambda p: np.ones((len(p), 1))
    return np.hstack([-2 * u, norm(u), one(u)]) @ np.hstack([v, one(v), norm(v)]).T


class Codebook:
    """Entries of one part, with their segments."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [segments(entries, n) for n in LEVELS]
        self.compared = 0  # exact distances so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row; ties go to the lower number."""
        found = [self._nearest(x[k : k + BLOCK_ROWS]) for k in range(0, len(x), BLOCK_ROWS)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _distances(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.compared += len(i)
        d = x[i] - self.entries[j]
        return np.einsum("ij,ij->i", d, d)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(x))
        reached = np.full(len(x), np.iinfo(np.int64).max)
        left = np.ones((len(x), len(self.entries)), bool)
        for n, entries in zip(LEVELS, self.levels, strict=True):
            open_ = np.flatnonzero(left.sum(axis=1) > FEW) if n > LEVELS[0] else rows
            if not len(open_):
                break
            bound = np.where(left[open_], bounds(segments(x[open_], n), entries), np.inf)
            # the entry of the least bound gives a distance that is reached; entries beyond it are out
            reached[open_] = np.minimum(reached[open_], self._distances(x, open_, bound.argmin(axis=1)))
            left[open_] = bound <= reached[open_, None]
        # each row still has the entry whose distance was reached; entries are in ascending order
        i, j = np.nonzero(left)
        exact = self._distances(x, i, j)
        least = np.minimum.reduceat(exact, np.searchsorted(i, rows)) if len(rows) else exact
        hit = np.flatnonzero(exact == least[i])
        return j[hit[np.searchsorted(i[hit], rows)]], least


def _ints(values: np.ndarray) -> np.ndarray:
    whole = np.floor(values.astype(float) * SCALE)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // SCALE} has no exact distances in 64 bits")
    return whole.astype(np.int64)


def integers(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, ints (int32, little endian): a written table of the rows whose vector is whole.

    Vectors that are null, empty, or hold null or non-finite components are left out.
    """
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = chunk(b.column(2))
            off = np.asarray(vecs.offsets).astype(np.int64)
            whole = _ints(np.asarray(vecs.values)[off[0] : off[-1]]).astype("<i4").tobytes()
            at = (off - off[0]) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([whole[a:e] for a, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "label", "ints"])

    return written(rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad).mapInArrow(run, f"id long, label {label}, ints binary"), "integers")


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(chunk(column).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _updated(whole: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """One round: parts go to their nearest entries, and entries become the means of their parts, rounded down."""
    edge = cuts(dims, len(books))
    width = max(np.diff(edge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for p, book in enumerate(codebooks):
                own = x[:, edge[p] : edge[p + 1]]
                code, _ = book.nearest(own)
                order = np.argsort(code, kind="stable")
                used, at = np.unique(code[order], return_index=True)
                if len(used):
                    sums[p][used, : own.shape[1]] += np.add.reduceat(own[order], at, axis=0)
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), *[pa.array(s[used, k]) for k in range(width)]], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    columns = [f"s{k}" for k in range(width)]
    sums = whole.select("ints").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in columns))
    # a row for each used entry and task; sums may exceed 64 bits
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns])
    new = [b.copy() for b in books]
    for row in total.toLocalIterator():  # PARTS * ENTRIES rows at most
        own = edge[row["part"] + 1] - edge[row["part"]]
        new[row["part"]][row["entry"]] = [int(row[c]) // row["n"] for c in columns[:own]]
    return new


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: id, code (hex, two digits a part), error, label_error and codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components are left out, and so are vectors of another
    length than that of the smallest kept id; components beyond 65 536 raise. The first codebook of each part is that
    part of the ``entries`` smallest ids' vectors, fewer if there are fewer; ids that repeat count each, in the order of
    their integers, and a null id comes last. A length that the number of parts does not divide gives parts that
    differ by one. Null labels are one label. Repeated rows get the same code. An empty table gives an empty result,
    and other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    whole = integers(rows, id_col, vec_col, label_col)
    first = whole.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    dims = len(first[0]["ints"]) // 4 if first else parts
    first = [r["ints"] for r in first if len(r["ints"]) == 4 * dims]
    if first and whole.where(F.length("ints") != 4 * dims).limit(1).count():
        whole = whole.where(F.length("ints") == 4 * dims)
        first = [r["ints"] for r in whole.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()]
    edge = cuts(dims, parts)
    start = np.frombuffer(b"".join(first), "<i4").reshape(-1, dims).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    for _ in range(rounds if first else 0):
        books = _updated(whole, books, dims)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    label = whole.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            found = [book.nearest(x[:, edge[p] : edge[p + 1]]) for p, book in enumerate(codebooks)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([code[k : k + 2 * parts] for k in range(0, len(code), 2 * parts)]), pa.array(error)], names=["id", "label", "code", "error"])

    coded = written(whole.mapInArrow(run, f"id long, label {label}, code string, error long"), "coded")
    sums = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def codes_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL for vectors of 64 components: every distance, no bounds."""
    q = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, k, ints[16 * p + k + 1] AS val FROM v, range(4) a(p), range(16) b(k)),
b0 AS MATERIALIZED (SELECT p, e, k, ints[16 * p + k + 1] AS val FROM (SELECT ints, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {ENTRIES}) f, range(4) a(p), range(16) b(k)),
"""
    near = lambda i: f"""n{i} AS MATERIALIZED (SELECT vec_id, p, min(d) AS d, arg_min(e, d * 256 + e) AS e FROM (
  SELECT x.vec_id, x.p, b.e, sum((x.val - b.val) * (x.val - b.val))::BIGINT AS d FROM x JOIN b{i} b ON x.p = b.p AND x.k = b.k GROUP BY ALL) t GROUP BY ALL),
"""  # noqa: E731
    for i in range(rounds):
        q += near(i)
        q += f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.k, coalesce(m.val, b.val) AS val FROM b{i} b LEFT JOIN
  (SELECT n.p, n.e, x.k, (sum(x.val) - ((sum(x.val) % count(*)) + count(*)) % count(*)) // count(*) AS val FROM n{i} n JOIN x ON x.vec_id = n.vec_id AND x.p = n.p GROUP BY ALL) m USING (p, e, k)),
"""
    q += near(rounds)
    q += f"""c AS MATERIALIZED (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(CAST(val::BIGINT AS VARCHAR), ',' ORDER BY p, e, k)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"""
    return q


OP11_SQL = codes_sql()
