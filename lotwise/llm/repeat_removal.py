"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over WIDTH bytes sets triggers, which end phrases; where they lie depends on nothing but the bytes
before, so that equal passages are cut alike wherever they stand. A suffix of the corpus is a suffix of a phrase (the
dictionary's part, read backwards from the phrase's end) followed by a suffix of the sequence of phrases (the parse's
part), and the corpus order is that of these two together. Strings of LENGTH bytes that are equal hold the same first
trigger at the same place, with the same ANCHOR bytes after it. So phrase ends are dealt by their anchor, and a task
has all those among which equal strings can lie. There both parts are sorted as bytes, each to the depth that a string
can reach, with the longest common prefixes of neighbours: the dictionary's suffix array and that of the parse. A
string that begins ``a`` bytes before the phrase's end is repeated if another end has the same ``a`` bytes before and
the same LENGTH - ``a`` bytes after: if both are in one run of either array at those depths.

Texts go first of which no anchor occurs again; contexts that are equal in a batch of texts are sent once. A string
without a trigger takes the place of its least hash in the trigger's stead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, U64, buffers, fragments, from_byte, global_counts, mix, narrow_batches, only, prefix_hash, span_hash, spans, text_batches, to_byte, to_slices, unpack, written

LENGTH, WIDTH, EVERY = 400, 8, 48
#: Share of a string's bytes after the trigger that make its anchor.
ANCHOR = 0.32
#: Bytes of a fingerprint that the first counts keep.
NARROW = 5
#: Phrase ends of one anchor that are sorted in one task at most; the strings at a more frequent anchor are counted one
#: by one, by 64-bit fingerprints, so that equal ones are added up before they meet.
HOT = 1 << 17
#: Contexts that are sorted at a time (whole anchors), bytes of contexts of a task (about).
SORT_ROWS, TASK_BYTES = 8_192, 48 << 20
SLICES = "frag int, batch long, hashes binary, counts binary"


def triggers(c: np.ndarray, off: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Ends of the trigger windows; windows lie within one text."""
    n = len(c) - 1
    if n < WIDTH:
        return np.zeros(0, np.int64)
    s = np.arange(n - WIDTH + 1)
    hit = s[mix(span_hash(c, s, s + WIDTH)) < U64((1 << 64) // every)] + WIDTH
    text = np.searchsorted(off, hit - 1, "right") - 1
    return hit[hit - WIDTH >= off[text]]


class Parse:
    """Phrase ends of the texts of a batch, and the strings (starts low to high) that each one answers for."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int = LENGTH, every: int = EVERY):
        self.length, self.c = length, prefix_hash(data)
        self.after = int(length * ANCHOR)
        self.reach = length - self.after  # a string's trigger ends so many bytes after its start at most
        ends = triggers(self.c, off, every)
        text = np.searchsorted(off, ends - 1, "right") - 1
        first, last = off[text], off[text + 1] - length
        before = np.full(len(ends), -1, np.int64)
        before[1:] = ends[:-1]
        # a string belongs to the first trigger that it holds, if the anchor lies in it
        low = np.maximum(np.maximum(before - WIDTH + 1, ends - self.reach), first)
        high = np.minimum(ends - WIDTH, last)
        use = low <= high
        ends, low, high = ends[use], low[use], high[use]
        open_ = np.zeros(len(data) + 1, np.int32)
        size = np.diff(off)
        long = np.flatnonzero(size >= length)
        open_[off[long]] += 1
        open_[off[long + 1] - length + 1] -= 1
        np.subtract.at(open_, low, 1)
        np.add.at(open_, high + 1, 1)
        bare = np.flatnonzero(np.cumsum(open_[:-1]) > 0)  # far from any trigger
        if len(bare):
            more = self.least(bare)
            new = np.flatnonzero(np.diff(more, prepend=-1) | (np.diff(bare, prepend=-2) != 1))
            ends, low, high = (np.concatenate(x) for x in ((ends, more[new]), (low, bare[new]), (high, bare[np.append(new[1:], len(bare)) - 1])))
        self.ends, self.low, self.high = ends, low, high

    def least(self, starts: np.ndarray) -> np.ndarray:
        """For strings without a trigger the end of the window, of those that a trigger could have, that has the least hash."""
        wide = self.reach - WIDTH + 1
        out = np.empty(len(starts), np.int64)
        cut = [*np.flatnonzero(np.diff(starts, prepend=-2) != 1).tolist(), len(starts)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            s = np.arange(starts[x], starts[y - 1] + wide)
            h = mix(span_hash(self.c, s, s + WIDTH))
            out[x:y] = np.lib.stride_tricks.sliding_window_view(h, wide).argmin(axis=1) + starts[x:y] + WIDTH
        return out

    def anchors(self) -> np.ndarray:
        """Beginnings of the parse's part."""
        return mix(span_hash(self.c, self.ends - WIDTH, self.ends + self.after))

    def strings(self, s: np.ndarray) -> np.ndarray:
        return mix(span_hash(self.c, s, s + self.length) + U64(2))


def _sliced(batch: int, keys: np.ndarray, weights: np.ndarray | None, f: int, width: int) -> pa.RecordBatch | None:
    """Slices of a batch's distinct keys with their summed weights."""
    if not len(keys):
        return None
    known, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=weights, minlength=len(known)).astype(np.int64)
    rows = list(to_slices(batch, known, total, f, width))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["frag", "batch", "hashes", "counts"])


def _told(keys: np.ndarray, parts: list[bytes] | None) -> np.ndarray:
    """Counts of a batch's keys, in their order."""
    if not len(keys):
        return np.zeros(0, np.uint8)
    return np.frombuffer(b"".join(parts), np.uint8)[np.unique(keys, return_inverse=True)[1]]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the closed ranges on end."""
    size = high - low + 1
    to = np.concatenate([[0], np.cumsum(size)])
    return np.arange(to[-1]) + np.repeat(low - to[:-1], size)


def surveyed(docs: DataFrame, id_col: str, text_col: str, length: int, every: int, f: int) -> DataFrame:
    """For each batch of texts a row with ids, sizes, digests and the owners of its keys, and rows of slices of the keys."""
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in spans(off, BATCH_BYTES):
                part, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                p = Parse(part, cut, length, every)
                keys = p.anchors()
                owner = np.searchsorted(cut, p.low, "right") - 1
                order = np.argsort(keys, kind="stable")
                fresh = np.ones(len(keys), bool)
                fresh[1:] = keys[order][1:] != keys[order][:-1]
                got = _sliced(seq, keys, None, f, NARROW)
                if got is not None:
                    yield out(*got.columns, *[pa.nulls(got.num_rows, t) for t in (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary())])
                raw = part.tobytes()
                digests = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield out(pa.array([-1], pa.int32()), pa.array([seq], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([b.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(cut).tolist()], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.string())), pa.array([owner[order].astype(np.uint32).tobytes()], pa.binary()), pa.array([np.packbits(fresh).tobytes()], pa.binary()))
                seq += 1

    def out(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["frag", "batch", "hashes", "counts", "ids", "sizes", "digests", "owner", "fresh"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, SLICES + ", ids array<long>, sizes array<long>, digests array<string>, owner binary, fresh binary"), "surveyed")


def live(table: DataFrame) -> DataFrame:
    """Ids of the texts of which a key occurs again, in them or elsewhere."""
    counts = global_counts(table.where("frag >= 0").select("frag", "batch", "hashes", "counts"), NARROW)
    held = table.where("frag = -1").select("batch", "ids", "owner", "fresh").join(counts.withColumnRenamed("batch", "_b"), F.col("batch") == F.col("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, owner, fresh, parts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                owner = np.frombuffer(owner, np.uint32)
                place = np.cumsum(np.unpackbits(np.frombuffer(fresh, np.uint8), count=len(owner))) - 1
                total = np.frombuffer(b"".join(parts), np.uint8)[place]
                good = np.unique(owner[total > 1]).tolist()
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in good], pa.int64())], names=["id"])

    return written(held.select("ids", "owner", "fresh", "counts").mapInArrow(run, "id long"), "live")


class Contexts:
    """Of a batch's phrase ends with a shared anchor the distinct contexts: the bytes that their strings reach."""

    def __init__(self, p: Parse, data: np.ndarray, use: np.ndarray, f: int):
        self.ends, low, high = p.ends[use], p.low[use], p.high[use]
        anchors = p.anchors()[use]
        raw = data.tobytes()
        known: dict[tuple[int, bytes], int] = {}
        uid = np.array([known.setdefault((e - a, raw[a : b + p.length]), len(known)) for e, a, b in zip(self.ends.tolist(), low.tolist(), high.tolist(), strict=True)], np.int64)
        lead = np.unique(uid, return_index=True)[1]
        frag = (anchors[lead] >> U64(32)).astype(np.int64) * f >> 32
        order = np.argsort(frag, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.uid = place[uid]  # contexts are numbered by fragment
        lead = lead[order]
        self.frag, self.n = frag[order], np.bincount(self.uid, minlength=len(lead))
        self.anchors, self.left = anchors[lead], self.ends[lead] - low[lead]
        self.least = self.ends[lead] - high[lead]
        texts = [x for _, x in known]
        self.texts = [texts[i] for i in order.tolist()]

    def rows(self, batch: int) -> pa.RecordBatch:
        cut = [*np.flatnonzero(np.diff(self.frag, prepend=-1)).tolist(), len(self.frag)]
        out = [(int(self.frag[x]), batch, self.anchors[x:y].tobytes(), self.left[x:y].astype(np.uint32).tobytes(), self.least[x:y].astype(np.uint32).tobytes(), np.minimum(self.n[x:y], 2).astype(np.uint8).tobytes(), b"".join(self.texts[x:y])) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["frag", "batch", "anchors", "left", "least", "n", "texts"])


def _sorted_runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row of bytes in their order, and for each rank the common prefix with the row before (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(a).view(f"V{a.shape[1]}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = a[order[1:]] != a[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return rank, common


def repeated_strings(data: np.ndarray, at: np.ndarray, left: np.ndarray, least: np.ndarray, n: np.ndarray, length: int, reach: int) -> np.ndarray:
    """For distinct contexts (from data[at]) whether the string that begins a bytes before the phrase's end is repeated: a column for each a from WIDTH to reach.

    ``n`` is how often a context occurs. Rows of other anchors do no harm: they differ in the bytes.
    """
    out = np.zeros((len(at), reach - WIDTH + 1), bool)
    end, right = at + left, length - least
    j, k = np.arange(int(left.max())), np.arange(int(right.max()))
    behind = np.where(j < left[:, None], data[np.maximum(end[:, None] - 1 - j, 0)], 0).astype(np.uint8)
    ahead = np.where(k < right[:, None], data[np.minimum(end[:, None] + k, len(data) - 1)], 0).astype(np.uint8)
    (phrase, common), (parse, follow) = _sorted_runs(behind), _sorted_runs(ahead)
    for a in range(WIDTH, reach + 1):
        rows = np.flatnonzero((left >= a) & (least <= a))
        if not len(rows):
            continue
        key = np.cumsum(common < a)[phrase[rows]] * np.int64(len(at) + 1) + np.cumsum(follow < length - a)[parse[rows]]
        _, same = np.unique(key, return_inverse=True)
        out[rows, a - WIDTH] = np.bincount(same, weights=n[rows])[same] > 1
    return out


def corpus_order(contexts: DataFrame, length: int, reach: int) -> DataFrame:
    """batch, bits: for each context of a batch, in order, the packed bits of its repeated strings."""

    def sort(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        anchors, left, least, n = get("anchors", np.uint64), get("left", np.uint32).astype(np.int64), get("least", np.uint32).astype(np.int64), get("n", np.uint8)
        raw = b"".join(table.column("texts").to_pylist())
        size = left + length - least
        at = np.concatenate([[0], np.cumsum(size)])
        known: dict[tuple[int, bytes], int] = {}
        uid = np.array([known.setdefault((k, raw[x:y]), len(known)) for k, x, y in zip(left.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
        lead = np.unique(uid, return_index=True)[1]
        times = np.bincount(uid, weights=n)
        data, wide = np.frombuffer(raw, np.uint8), reach - WIDTH + 1
        bits = np.zeros((len(lead), -(-wide // 8)), np.uint8)
        order = np.argsort(anchors[lead], kind="stable")
        cut = np.flatnonzero(np.diff(anchors[lead][order], prepend=anchors[lead][order[:1]] ^ U64(1)))
        full = np.diff(np.append(cut, len(order)))
        alone = order[cut[full == 1]]  # no other context has the anchor
        a = np.arange(WIDTH, reach + 1)
        own = (a <= left[lead[alone]][:, None]) & (a >= least[lead[alone]][:, None]) & (times[alone] > 1)[:, None]
        bits[alone] = np.packbits(own, axis=1)
        groups = [(x, x + k) for x, k in zip(cut.tolist(), full.tolist(), strict=True) if k > 1]
        held: list[np.ndarray] = []
        for i, (x, y) in enumerate(groups):
            held.append(order[x:y])
            if i + 1 == len(groups) or sum(map(len, held)) + groups[i + 1][1] - groups[i + 1][0] > SORT_ROWS:
                rows = np.concatenate(held)
                bits[rows] = np.packbits(repeated_strings(data, at[lead[rows]], left[lead[rows]], least[lead[rows]], times[rows], length, reach), axis=1)
                held = []
        edge = np.concatenate([[0], np.cumsum([len(x) // 8 for x in table.column("anchors").to_pylist()])])
        return pa.table({"batch": table.column("batch"), "frag": table.column("frag"), "part": pa.array([bits[uid[x:y]].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    parts = contexts.groupBy("frag").applyInArrow(sort, "batch long, frag int, part binary")
    return parts.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("frag", "part"))).alias("p")).select(F.col("batch").alias("_o"), F.transform("p", lambda x: x["part"]).alias("bits"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, every: int = EVERY, texts: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, has_repeats and, with ``texts``, the kept bytes.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of ``length`` bytes (at least 64) that covers
    it also starts anywhere else, in the same text or another; strings never cross texts and are judged on the input.
    So every copy of a repeated row goes. Null ids are ids like any other. Empty tables give empty results; other
    columns are not read. Strings are compared byte by byte, but for those at anchors with more than ``hot`` phrase
    ends, which are told by 64-bit fingerprints. A text stands in memory as a whole, with some fifty bytes for each of
    its own.
    """
    if length < 64:
        raise ValueError("strings of less than 64 bytes are too short for the anchors")
    f = fragments(docs, text_col)
    table = surveyed(docs, id_col, text_col, length, every, f)
    ids = written(live(table).distinct(), "live")
    packed = text_batches(only(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", ids), "id", "text")
    reach = length - int(length * ANCHOR)

    # phrase ends with the number of those that have their anchor
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, sizes, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                got = _sliced(batch, Parse(*unpack(sizes, data), length, every).anchors(), None, f, 8)
                if got is not None:
                    yield got

    counts = global_counts(packed.select("batch", "sizes", "data").mapInArrow(parsed, SLICES), 8)
    counts = written(counts.withColumnRenamed("batch", "_b"), "anchors")
    work = packed.join(counts, F.col("batch") == F.col("_b"), "left")
    live_bytes = packed.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    tasks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-live_bytes * (length + reach) // every // TASK_BYTES))

    def parts(sizes: bytes, data: bytes, told: list[bytes] | None) -> tuple[Parse, np.ndarray, np.ndarray, Contexts | None, np.ndarray]:
        """Of a batch the parse, its bytes and offsets, the contexts to sort, and the strings at hot anchors."""
        data, off = unpack(sizes, data)
        p = Parse(data, off, length, every)
        n = from_byte(_told(p.anchors(), told))
        use, busy = (n > 1) & (n <= hot), n > hot
        return p, data, off, Contexts(p, data, use, tasks) if use.any() else None, _ranges(p.low[busy], p.high[busy])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, sizes, data, told in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = parts(sizes, data, told)[3]
                if own:
                    yield own.rows(batch)

    contexts = work.select("batch", "sizes", "data", "counts").mapInArrow(sent, "frag int, batch long, anchors binary, left binary, least binary, n binary, texts binary")
    order = corpus_order(contexts.repartition(tasks, "frag"), length, reach)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, sizes, data, told in zip(*[c.to_pylist() for c in b.columns], strict=True):
                p, *_, starts = parts(sizes, data, told)
                got = _sliced(batch, p.strings(starts), None, f, 8)
                if got is not None:
                    yield got

    limit = int(to_byte(np.array([hot]))[0])

    def busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, told in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if np.frombuffer(b"".join(told), np.uint8).max(initial=0) > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64())], names=["batch"])

    loud = written(counts.select("_b", "counts").mapInArrow(busy, "batch long"), "hot")
    hits = global_counts(work.join(loud, "batch", "left_semi").select("batch", "sizes", "data", "counts").mapInArrow(strings, SLICES), 8).select(F.col("batch").alias("_h"), F.col("counts").alias("hits"))
    done = work.join(order, F.col("batch") == F.col("_o"), "left").join(hits, F.col("batch") == F.col("_h"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owners, sizes, data, told, bits, again in zip(*[c.to_pylist() for c in b.columns], strict=True):
                p, data, off, own, starts = parts(sizes, data, told)
                cover = np.zeros(len(data) + 1, np.int32)
                if len(starts):
                    starts = starts[_told(p.strings(starts), again) > 1]
                    np.add.at(cover, starts, 1)
                    np.subtract.at(cover, starts + length, 1)
                if own:
                    marks = np.frombuffer(b"".join(bits), np.uint8).reshape(len(own.frag), -1)
                    for x in range(0, len(own.ends), 1 << 14):
                        row, a = np.nonzero(np.unpackbits(marks[own.uid[x : x + (1 << 14)]], axis=1, count=reach - WIDTH + 1))
                        begin = own.ends[x + row] - a - WIDTH
                        np.add.at(cover, begin, 1)
                        np.subtract.at(cover, begin + length, 1)
                gone = np.cumsum(cover[:-1]) > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                at = off[:-1][np.diff(off) > 0]
                begin[at] = gone[at]
                sums, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begin))
                raw = data.tobytes()
                rows = []
                for k, i in enumerate(owners):
                    x, y = int(off[k]), int(off[k + 1])
                    n = int(sums[y] - sums[x])
                    kept = data[x:y][~gone[x:y]].tobytes() if n else raw[x:y]
                    rows.append((i, y - x, n, int(runs[y] - runs[x]), hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = done.select("ids", "sizes", "data", "counts", "bits", "hits").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = table.where("frag = -1").select(F.explode(F.arrays_zip("ids", "sizes", "digests")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.sizes").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("x.digests").alias("kept_sha256"))
    rest = rest.join(ids.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    if texts:
        plain = docs.select(F.col(id_col).cast("long").alias("_i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("kept")).join(ids.withColumnRenamed("id", "_id"), F.col("_i").eqNullSafe(F.col("_id")), "left_anti")
        rest = plain.select(F.col("_i").alias("id"), F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    names = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"), *(["kept"] if texts else [])]
    return found.select(names).unionByName(rest.select(names))


def op10_repeat_removal(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def removed_by_force(texts: list[bytes | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same of a few texts by a table of all their strings: bytes, removed, runs, digest. For tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t or b"") - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        t = t or b""
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
