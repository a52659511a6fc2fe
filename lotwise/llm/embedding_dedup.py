"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. A rotation spreads the distance over the axes; cut
into blocks, at least one block of such a pair is within its share of that budget. Each block is a range join: vectors
fall into cells along the block's first axis, as wide as the block's radius, and meet those of their own and the next
cell. A pair counts in its first block within budget, so the union of candidates holds it once, and its cosine is then
computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, narrow_batches, written

THRESHOLD, BLOCKS, SEED = 0.9, 4, 3
#: Vectors of a cell that meet in one task; fuller cells are cut into chunks, and every pair of chunks meets.
CHUNK_ROWS, SLICE, PAIRS = 16_384, 512, 50_000
_ROWS = "id long, n long, dims int, block int, cell int, home boolean, vec binary"


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unit vectors, rotated; each row by the same operations in the same order, whatever the batch."""
    q = rotation(x.shape[1], seed)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    out = np.zeros_like(unit)
    for j in range(x.shape[1]):
        out += unit[:, j : j + 1] * q[j]
    return out


def blocks(dims: int, threshold: float, m: int = BLOCKS) -> list[tuple[int, int, float]]:
    """(first axis, end, squared-distance budget) of each block: budgets are proportional to the axes."""
    cut = [round(i * dims / min(m, dims)) for i in range(min(m, dims) + 1)]
    return [(a, b, (2 - 2 * threshold) * (b - a) / dims * (1 + 1e-9)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, by a power of two where squares could overflow or vanish."""
    top = np.abs(x).max(axis=1)
    odd = (top > 1e100) | (top < 1e-100)
    if odd.any():
        x = x.copy()
        x[odd] /= np.exp2(np.floor(np.log2(top[odd])))[:, None]
    return x


def joined(ids: np.ndarray, n: np.ndarray, home: np.ndarray, side: np.ndarray, x: np.ndarray, block: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (weighted by copies) and its root in the group's own forest of links."""
    spans = blocks(x.shape[1], threshold)
    r = rotated(x)
    length = np.sqrt((x * x).sum(axis=1))
    a, b, budget = spans[block]
    low = r[:, a:b].astype(np.float32)
    # one product gives -distance / 2: the block beside 1 and -norm / 2, against -norm / 2 and 1
    half, one = -(low * low).sum(axis=1, keepdims=True) / 2, np.ones((len(low), 1), np.float32)
    ahead, behind = np.hstack([low, one, half]).astype(np.float32), np.ascontiguousarray(np.hstack([low, half, one]).astype(np.float32).T)
    left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not same:
        behind = np.ascontiguousarray(behind[:, right])
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(left), SLICE):
        first = s if same else 0
        near = ahead[left[s : s + SLICE]] @ behind[:, first:] >= np.float32(-(budget + 1e-5) / 2)
        at = np.flatnonzero(near)
        p, q = left[s + at // near.shape[1]], right[first + at % near.shape[1]]
        ok = home[p] | home[q]
        if same:
            ok &= p < q
        p, q = p[ok], q[ok]
        for k in range(0, len(p), PAIRS):
            u, w = p[k : k + PAIRS], q[k : k + PAIRS]
            dist = (r[u] - r[w]) ** 2
            ok = dist[:, a:b].sum(axis=1) <= budget
            for c, e, most in spans[:block]:  # counted there
                ok &= dist[:, c:e].sum(axis=1) > most
            u, w = u[ok], w[ok]
            ok = (x[u] * x[w]).sum(axis=1) / (length[u] * length[w]) >= threshold
            u, w = u[ok], w[ok]
            np.add.at(links, u, n[w])
            np.add.at(links, w, n[u])
            found.append((u, w))
    if found:
        root = forest(*(np.concatenate(z) for z in zip(*found, strict=True)), len(ids))
    return links, root


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per row of vectors: id, n_links, component_id and kept.

    Two vectors of one dimension link if their cosine in double precision is >= ``threshold`` (> 0). Equal vectors are
    joined once, with their number; their links to each other count. Vectors that are null, empty, zero, or hold a
    null or non-finite component link with nothing, nor does a row without an id. Rows that repeat an id with another
    vector share its links and component. Empty tables give empty results; other columns are not read.
    """
    spark = vectors.sparkSession
    narrow_batches(spark)
    kind = np.float64 if dict(vectors.dtypes)[vector_col] == "array<double>" else np.float32
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    v = F.col("v")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    classes = written(rows.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = np.array(batch.column(1)), np.array(batch.column(2))
            size = np.array([len(x) for x in batch.column(0)])
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                pick = np.flatnonzero(size == d)
                raw = flat[at[pick][:, None] + np.arange(d)]
                r = rotated(_scaled(raw.astype(np.float64)))
                vec = pa.array([x.tobytes() for x in raw], pa.binary())
                for k, (a, _, budget) in enumerate(blocks(int(d), threshold)):
                    cell = np.floor(r[:, a] / (math.sqrt(budget) * (1 + 1e-9))).astype(np.int32)
                    for step, home in ((0, True), (1, False)):
                        m = len(pick)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(n[pick]), pa.array(np.full(m, d, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(cell + np.int32(step)), pa.array(np.full(m, home)), vec], names=["id", "n", "dims", "block", "cell", "home", "vec"])

    placed = classes.select("v", "id", "n").mapInArrow(cells, _ROWS)
    key = ["dims", "block", "cell"]
    # how full the cells are: a row for each cell; from that, how many chunks
    full = written(placed.groupBy(key).agg(F.count("*").alias("rows"), F.max("home").alias("any")).select(*key, F.ceil(F.col("rows") / chunk_rows).cast("int").alias("chunks")), "cells")
    placed = placed.join(full, key).withColumn("chunk", F.pmod(F.xxhash64("id", "home"), F.col("chunks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).select(*key, "i", "j", (F.col("chunk") != F.col("i")).cast("int").alias("side"), "id", "n", "home", "vec")

    def meet(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("dims", "block", "i", "j")}
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(len(ids), first["dims"]).astype(np.float64)
        links, root = joined(ids, n, table.column("home").to_numpy(zero_copy_only=False).astype(bool), table.column("side").to_numpy(), _scaled(x), first["block"], threshold, first["i"] == first["j"])
        got = np.flatnonzero(links)
        return pa.table({"id": ids[got], "links": links[got], "root": ids[root[got]]})

    linked = written(met.groupBy(*key, "i", "j").applyInArrow(meet, "id long, links long, root long"), "links")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = classes.join(counts, "id", "left").join(parts, classes["id"] == parts["node"], "left").select("v", F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", classes["id"]).alias("component"))
    out = rows.withColumn("v", F.when(F.col("ok"), F.col("v"))).join(sums, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE ok AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN comp ON v = vec_id LEFT JOIN deg ON a = vec_id
"""
