"""Chat formatting by columnar byte assembly: segment lengths, offsets and scatter indices in numpy, one Arrow buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, narrow_batches

#: Fixed template strings: start of a turn, end of its header line, end of a turn.
START, LINE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: ``<|`` opens every control string; in texts ``<``, any backslashes and ``|`` get one backslash more.
_OPEN, _SHUT = re.compile(rb"<\\*\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<long>"


def _role(role: str) -> bytes:
    text = role.replace("\\", "\\\\").replace("\n", "\\n").encode()
    return _OPEN.sub(lambda m: m[0][:1] + b"\\" + m[0][1:], text)


def _unrole(text: str) -> str:
    text = _SHUT.sub(r"<\1|", text)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def assemble(texts: pa.Array, roles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one buffer: bytes, offsets of the turns, and first and end code point of each text in its turn."""
    data, off = buffers(texts)
    n, size = len(off) - 1, np.diff(off)
    names, code = np.unique(np.array(roles, object).astype(str), return_inverse=True) if n else (np.array([], str), np.zeros(0, int))
    heads = [START + _role(str(x)) + LINE for x in names]
    head = np.array([len(x) for x in heads], np.int64)[code] if n else np.zeros(0, np.int64)
    found = [m.span() for m in _OPEN.finditer(data.tobytes())] if (data == 0x3C).any() else []
    if found:  # only those within one text
        span = np.array(found, np.int64)
        own = np.searchsorted(off, span[:, 0], "right") == np.searchsorted(off, span[:, 1] - 1, "right")
        extra = span[own, 0] + 1
    else:
        extra = np.zeros(0, np.int64)
    more = np.searchsorted(extra, np.arange(len(data)), "right") if len(extra) else 0  # backslashes before each byte
    at = np.searchsorted(extra, off)  # and before each text
    seg = head + size + np.diff(at) + len(END)
    to = np.concatenate([[0], np.cumsum(seg)]).astype(np.int64)
    out = np.empty(int(to[-1]), np.uint8)
    where = np.arange(len(data)) + np.repeat(to[:-1] + head - off[:-1] - at[:-1], size) + more
    out[where] = data
    if len(extra):
        out[where[extra] - 1] = 0x5C
    for k, h in enumerate(heads):
        rows = np.flatnonzero(code == k)
        out[to[rows][:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    if n:
        out[(to[1:] - len(END))[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    first = points[to[:-1] + head] - points[to[:-1]]
    return out, to, first, points[to[1:] - len(END)] - points[to[:-1]]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted and loss_spans (code points: start, end, start, end, ...).

    Turns are in order of turn (null first; ties by role, then text). A null text or role is empty; null ids are one
    conversation. The loss mask covers each assistant text, without its marks. Texts may hold control strings: they
    are escaped, and ``unescape`` restores them. An empty table gives an empty result. Other columns are not read. A
    conversation is one text, so it is assembled in one task, over as many batches of turns as it takes.
    """
    narrow_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the turns of a conversation that may go on

        def whole(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            conv = table.column(0).to_pylist()
            roles = table.column(1).to_pylist()
            texts = table.column(2).cast(pa.large_string()).combine_chunks()
            out, to, first, last = assemble(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, roles)
            start = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
            edge = np.array([*start, len(conv)])
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            spans = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                base = points[to[a]]
                spans.append([int(x) for i in range(a, b) if roles[i] == LOSS_ROLE for x in (points[to[i]] - base + first[i], points[to[i]] - base + last[i])])
            off = to[edge]
            text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out))
            return pa.RecordBatch.from_arrays([pa.array([conv[i] for i in start], pa.int64()), pa.array(np.diff(edge), pa.int64()), text.cast(pa.string()) if len(out) < 2**31 - 1 else text, pa.array(spans, pa.list_(pa.int64()))], names=["conv_id", "n_turns", "formatted", "loss_spans"])

        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_pylist()
            cut = len(conv) - 1
            while cut and conv[cut - 1] == conv[-1]:
                cut -= 1
            goes_on = held and held[-1].column(0)[-1].as_py() == conv[0]
            if cut or (held and not goes_on):
                yield whole(pa.concat_tables([*held, pa.Table.from_batches([b.slice(0, cut)])]))
                held = []
            held.append(pa.Table.from_batches([b.slice(cut)]))
        if held:
            yield whole(pa.concat_tables(held))

    return rows.mapInArrow(run, FORMATTED)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                turns = parse_chat(text)
                loss = "".join(unescape(text[a:e]) for a, e in zip(spans[::2], spans[1::2], strict=True))
                sha = hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                rows.append((conv, len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, DIGESTS)


#: Fixed rows of the contract: a conversation of control strings of another template.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql("VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in EXTRA) + " AS t(conv_id, turn, role, text)")
    return digests(format_chats(turns.unionByName(extra)))


OP7_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
