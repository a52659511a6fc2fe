"""Sampled SentencePiece segmentation: forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice of a text factorises where a run of spaces begins: no piece holds a space after another character (checked
on loading), so every segment (spaces and what follows them) is a lattice of its own. Weights come from the order of
the pieces: p is proportional to 1 / (rank + RANK_SHIFT), raised to ``theta``. Spaces are the model's U+2581; a U+2581
in a text itself is written in byte pieces, like every character without a piece, so that decoding loses nothing.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, mix, narrow_batches, prefix_hash, span_hash, spans

#: Where the vocabulary lies; a parameter of every function that needs it.
MODEL_PATH = os.environ.get("LOTWISE_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
THETA, RANK_SHIFT, BYTE_COST, SEED = 0.5, 10.0, 2.0, 11
CHUNK = 1 << 20
_SLOTS = 22


class Pieces:
    """The vocabulary as tables of hashes: of pieces and of their beginnings."""

    def __init__(self, path: str = MODEL_PATH, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        raw: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        plain = []
        for i in range(self.size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                if "▁" in text.lstrip("▁"):
                    raise ValueError("a piece holds a space after another character")
                raw.append(text.replace("▁", " ").encode())
                plain.append(i)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        rank = np.arange(len(plain)) + RANK_SHIFT
        weight = np.full(self.size, -np.inf)
        weight[plain] = -theta * np.log(rank)
        weight[self.byte_id] = weight[plain].min() - BYTE_COST
        self.weight = weight
        # piece and beginning tables: hash slot -> hash, id (-1: only a beginning)
        known: dict[bytes, int] = {}
        for i in plain:
            for k in range(1, len(raw[i])):
                known.setdefault(raw[i][:k], -1)
            known[raw[i]] = i
        self.longest = max(len(raw[i]) for i in plain)
        # the bytes of each piece, eight to a number
        padded = np.zeros((self.size, -(-self.longest // 8) * 8), np.uint8)
        for i in plain:
            padded[i, : len(raw[i])] = np.frombuffer(raw[i], np.uint8)
        self.words = np.ascontiguousarray(padded.view("<u8").T)
        keys = list(known)
        data = np.frombuffer(b"".join(keys), np.uint8)
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        h = self.hash(prefix_hash(data), cut[:-1], cut[1:])
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        self.slots = np.full((1 << _SLOTS) + 64, 0, np.uint64)
        self.ids = np.full((1 << _SLOTS) + 64, -1, np.int32)
        for x, i in zip(h.tolist(), known.values(), strict=True):
            at = x >> (64 - _SLOTS)
            while self.slots[at]:
                at += 1
            self.slots[at], self.ids[at] = x, i
        self.char = np.zeros(0)

    @staticmethod
    def hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix(span_hash(c, s, e)) | U64(1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known as a beginning, and its piece or -1."""
        at = (h >> U64(64 - _SLOTS)).astype(np.int64)
        got = self.slots[at]
        hit, open_ = got == h, np.flatnonzero((got != h) & (got != 0))
        ids = np.where(hit, self.ids[at], -1)
        while len(open_):
            at[open_] += 1
            got = self.slots[at[open_]]
            same = got == h[open_]
            hit[open_[same]] = True
            ids[open_[same]] = self.ids[at[open_[same]]]
            open_ = open_[~same & (got != 0)]
        return hit, ids


def eights(data: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place on as a number, with ``more`` zeros behind the data."""
    padded = np.concatenate([data, np.zeros(more + 16 - (len(data) + more) % 8, np.uint8)])
    out = np.empty(len(padded) - 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - 8) // 8 * 8].view("<u8")
        out[k::8] = part[: len(out[k::8])]
    return out


_LOADED: dict[tuple, Pieces] = {}


def pieces(path: str = MODEL_PATH, theta: float = THETA) -> Pieces:
    if (path, theta) not in _LOADED:
        _LOADED[path, theta] = Pieces(path, theta)
    return _LOADED[path, theta]


def lattice(v: Pieces, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the segments data[off[i]:off[i+1]] by end position: (row per byte, column per length - 1) ids or -1, and log weights."""
    n = len(data)
    seg = np.repeat(np.arange(len(off) - 1), np.diff(off))
    room = off[1:][seg] - np.arange(n)  # bytes left in the segment from each start
    c = prefix_hash(data)
    eight = eights(data, v.longest)
    ids = np.full((n, v.longest), -1, np.int32)
    alive, width = np.arange(n), 0
    for k in range(1, v.longest + 1):
        alive = alive[room[alive] >= k]
        if not len(alive):
            break
        hit, found = v.find(v.hash(c, alive, alive + k))
        has = np.flatnonzero(found >= 0)
        if len(has):  # a hash finds a piece, its bytes decide
            same = np.ones(len(has), bool)
            for j in range(0, k, 8):
                same &= eight[alive[has] + j] & U64((1 << 8 * min(8, k - j)) - 1) == v.words[j >> 3][found[has]]
            has = has[same]
            width = k
            ids[alive[has] + k - 1, k - 1] = found[has]
        alive = alive[hit]
    # a character without a piece is a chain of byte pieces
    first = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(first, n))
    bare = np.zeros(len(first), bool)
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        bare[rows] = ids[first[rows] + k - 1, k - 1] < 0 if k <= v.longest else True
    at = np.flatnonzero(np.repeat(bare, size))
    ids[at, 0] = v.byte_id[data[at]]
    width = max(width, 1)
    ids = ids[:, :width]
    return ids, np.where(ids >= 0, v.weight[ids], -np.inf)


#: Segments of more bytes are filtered one by one: steps over many segments at once don't pay for them.
LONG = 4096


def forward_one(weights: np.ndarray, cum: np.ndarray) -> None:
    """The same for one segment, byte by byte; fills cum."""
    width = weights.shape[1]
    total = [0.0]
    for x in range(0, len(weights), 1 << 15):
        out = []
        for j, row in enumerate(weights[x : x + (1 << 15)].tolist(), x):
            got = [(k, w + total[j - k]) for k, w in enumerate(row) if w > -math.inf and k <= j]
            top = max((v for _, v in got), default=-math.inf)
            line, s, at = [0.0] * width, 0.0, 0
            if top > -math.inf:
                for k, v in got:
                    line[at:k] = [s] * (k - at)
                    s += math.exp(v - top)
                    at = k
                line[at:] = [s] * (width - at)
                line = [v / s for v in line]
            line[min(width, j + 1) - 1 :] = [1.0] * (width - min(width, j + 1) + 1)
            total.append(top + math.log(s) if s else -math.inf)
            out.append(line)
        cum[x : x + len(out)] = out


def forward(weights: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the cumulative probabilities of the lengths of the piece that ends there, as filtered forward."""
    size = np.diff(off)
    cum = np.empty(weights.shape, np.float32)
    for i in np.flatnonzero(size > LONG).tolist():
        forward_one(weights[off[i] : off[i + 1]], cum[off[i] : off[i + 1]])
    size = np.where(size > LONG, 0, size)
    order = np.argsort(-size, kind="stable")
    start, size = off[:-1][order], size[order]
    width = weights.shape[1]
    total = np.zeros(len(weights) + 1)  # log of the summed weight of all segmentations up to each byte
    lengths = np.arange(1, width + 1)
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -j, "left"))  # segments longer than j
        end = start[:m] + j
        k = min(width, j + 1)
        w = weights[end, :k]
        if j:
            before = np.zeros((m, k))
            inner = min(k, j)
            before[:, :inner] = total[end[:, None] - lengths[:inner]]
            if k == j + 1:
                before[:, j] = 0.0
            w = w + before
        top = w.max(axis=1)
        top = np.where(np.isfinite(top), top, 0.0)
        p = np.exp(w - top[:, None])
        s = p.sum(axis=1)
        total[end] = np.where(s > 0, top + np.log(np.maximum(s, 1e-300)), -np.inf)
        np.cumsum(p, axis=1, out=p)
        cum[end, :k] = p / np.maximum(s, 1e-300)[:, None]
        cum[end, k:] = 1.0
        cum[end, k - 1] = 1.0
    return cum


def sample(v: Pieces, data: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of the texts data[off[i]:off[i+1]] on end, and the number of each text. Draws depend on a text's seed and place only."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    size = np.diff(off)
    full = size > 0
    # the dummy space in front of each text
    lead = np.cumsum(full)
    out = np.empty(len(data) + int(full.sum()), np.uint8)
    at = off[:-1][full] + lead[full] - 1
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[at], out[keep] = 0x20, data
    cut = np.concatenate([[0], np.cumsum(size + full)])
    text_first = np.zeros(len(out), bool)
    text_first[at] = True
    space = out == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1] | text_first[1:]
    s = np.flatnonzero(begin)
    e = np.append(s[1:], len(out))
    h = mix(span_hash(prefix_hash(out), s, e) + (e - s).astype(np.uint64))
    _, where, back = np.unique(h, return_index=True, return_inverse=True)
    us, ue = s[where], e[where]
    uoff = np.concatenate([[0], np.cumsum(ue - us)])
    ubytes = out[np.arange(uoff[-1]) + np.repeat(us - uoff[:-1], ue - us)]
    ids, w = lattice(v, ubytes, uoff)
    cum = forward(w, uoff)
    del w
    text = np.searchsorted(cut, s, "right") - 1
    chosen = np.full(len(out), -1, np.int32)
    left = e - s  # bytes of each segment not yet cut
    base, seed, begin_in_text = uoff[:-1][back], seeds[text], s - cut[text]
    active = np.arange(len(s))
    while len(active):
        end = base[active] + left[active] - 1
        place = (begin_in_text[active] + left[active]).astype(np.uint64)
        u = (mix(seed[active] + place * U64(0x9E3779B97F4A7C15)) >> U64(40)).astype(np.float32) / np.float32(1 << 24)
        rows = cum[end]
        k = (rows <= u[:, None]).sum(axis=1)
        left[active] -= k + 1
        chosen[s[active] + left[active]] = ids[end, k]
        active = active[left[active] > 0]
    got = chosen >= 0
    return chosen[got], np.add.reduceat(got.astype(np.int64), cut[:-1][full]) if full.all() else _counts(got, cut, full)


def _counts(got: np.ndarray, cut: np.ndarray, full: np.ndarray) -> np.ndarray:
    n = np.zeros(len(full), np.int64)
    n[full] = np.add.reduceat(got.astype(np.int64), cut[:-1][full])
    return n


def row_seed(keys: list, seed: int = SEED) -> np.ndarray:
    """64-bit seeds of row keys; equal keys have equal seeds."""
    return mix(np.array([hash_int(k) for k in keys], np.uint64) + np.array([seed], np.uint64) * U64(0xD1342543DE82EF95))


def hash_int(key) -> int:
    return (int(key) & (2**64 - 1)) if isinstance(key, int) else int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")


def detokenise(v: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of piece ids on end, without the dummy space."""
    size = (v.off[1:] - v.off[:-1])[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    out = v.blob[np.arange(to[-1]) + np.repeat(v.off[:-1][ids] - to[:-1], size)]
    cut = to[np.concatenate([[0], np.cumsum(count)])]
    full = np.diff(cut) > 0
    keep = np.ones(len(out), bool)
    keep[cut[:-1][full]] = False
    return out[keep], cut - np.concatenate([[0], np.cumsum(full)])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH, theta: float = THETA, seed: int = SEED, digest: bool = False) -> DataFrame:
    """id and pieces (array<int>) of each row: a segmentation sampled with the row's id as seed. With ``digest`` also
    text_sha256, the SHA-256 (hex) of the text that the pieces decode to, in the same pass.

    The same id, text, seed and model always give the same pieces, whatever the partitions. Null text gives null,
    empty text an empty array. Repeated rows get the same result; a null id is a key like any other. Other columns
    are not read. A text is cut at its spaces, never shortened. Equal segments of a batch share one lattice, which
    holds some 12 bytes for each byte and length of piece: a text without any space is one lattice as a whole.
    """
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path, theta)
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in spans(off, CHUNK):
                keys = b.column(0).slice(i, j - i)
                ids, n = sample(v, data[off[i] : off[j]], off[i : j + 1] - off[i], row_seed(keys.to_pylist(), seed))
                null = np.asarray(b.column(1).slice(i, j - i).is_null())
                cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids, pa.int32()), mask=pa.array(null) if null.any() else None)
                if not digest:
                    yield pa.RecordBatch.from_arrays([keys, rows], names=["id", "pieces"])
                    continue
                out, to = detokenise(v, ids.astype(np.int64), n)
                raw = out.tobytes()
                sha = [None if x else hashlib.sha256(raw[a:e]).hexdigest() for x, a, e in zip(null.tolist(), to[:-1].tolist(), to[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, rows, pa.array(sha, pa.string())], names=["id", "pieces", "text_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, pieces array<int>, text_sha256 string" if digest else "id long, pieces array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", path: str = MODEL_PATH) -> DataFrame:
    """id and text of each row of pieces, byte for byte what was encoded.

    Null pieces give null, no pieces the empty text. Repeated rows give the same text, a null id is passed on. Empty
    tables give empty results; other columns are not read.
    """
    narrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for b in batches:
            arr = b.column(1)
            n = np.array([0 if x is None else x for x in pc.list_value_length(arr).to_pylist()], np.int64)
            out, cut = detokenise(v, arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            null, raw = np.asarray(arr.is_null()), out.tobytes()
            texts = [None if x else raw[a:e] for x, a, e in zip(null.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: its sampled pieces, their number, and the digest of the text that they decode to."""
    back = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return back.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "text_sha256")
