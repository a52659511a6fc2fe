"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Archives are files in the shared folder, qualified on the driver and opened through Arrow's file systems. A writing task names its files
in its result, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow_batches, scratch, written

#: Payloads of at least so many bytes are written once; an archive is closed at ARCHIVE_BYTES.
MIN_BYTES, ARCHIVE_BYTES, CHUNK = 0, 1 << 30, 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = "path string, at long, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, verified boolean, payload binary"


#: Rows of one payload are dealt to so many parts where they meet its response.
SALTS = 32


def qualified(spark: SparkSession, path: str) -> str:
    """scheme://authority/path of a path as Spark takes it (the default file system where it names none), with nothing escaped."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a qualified path; schemes that only Hadoop's clients have are said by Arrow's names."""
    scheme, _, rest = path.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    try:
        return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{quote(rest)}")
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives are written through Arrow, which has no file system for {scheme}://; set spark.checkpoint.dir to a folder that it can open") from error


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    """A URL as a header value: control characters are percent-encoded, so that it stays on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = digest32(payload)
    if not revisit:
        block += payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}",
        *([f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages; returns the manifest (path, records, bytes).

    Of equal payloads of at least ``min_bytes`` the row with the largest id is a response and the others revisit it;
    rows that repeat that id are responses too, and a null id is below all others. Null payloads are empty. Other
    columns are not read; an empty table gives no archive. A payload is one value in memory, however long.
    """
    spark = pages.sparkSession
    narrow_batches(spark)
    base = qualified(spark, scratch(spark, "warc"))
    opened(base)  # fails here rather than in a task
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("k", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    twins = written(rows.where("k is not null").groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1").drop("n"), "twins")
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    twins = twins.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", salt).join(twins, (F.col("k") == F.col("k2")) & (F.col("salt") == F.col("part")), "left").select("id", "url", F.col("payload").cast("binary"), "top", (F.col("k2").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = opened(base)
        store.create_dir(root, recursive=True)
        part, out, name, n, size, done = TaskContext.get().partitionId(), None, "", 0, 0, []
        for b in batches:
            for i, url, payload, top, revisit in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    name, n, size = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                member = record(i, url, payload, top, revisit)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{base}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{base}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream, read once from start to end, a chunk at a time."""
    at, pos, data = 0, 0, b""
    z, parts = zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                if parts or pos != at:
                    raise ValueError(f"the archive ends within the record at {at}")
                return
        before = len(data)
        parts.append(z.decompress(data))
        data = z.unused_data
        pos += before - len(data)
        if z.eof:
            yield at, b"".join(parts)
            at, z, parts = pos, zlib.decompressobj(31), []


def parse(content: bytes) -> dict:
    """Headers and payload of a record: the block is Content-Length bytes, then two line ends and nothing else."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(field["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record is not as long as it says")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = field["warc-type"] == "revisit"
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda v: int(m[1]) if v and (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    good = "sha1:" + digest32(block) == field["warc-block-digest"] and (revisit or (digest32(payload) == digest and len(payload) == length))
    return {"page_id": number(field["warc-record-id"]), "record_type": field["warc-type"], "target_uri": field.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "refers_to": number(field.get("warc-refers-to")), "verified": good, "payload": None if revisit else payload}


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives (RECORD). A broken archive raises; a wrong digest gives verified = false.

    ``payloads`` false leaves the payload column null after its digest is verified. A record is held whole while it is
    read, others are not.
    """
    spark = manifest.sparkSession
    narrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = opened(path)
                with store.open_input_stream(name) as stream:
                    rows, held = [], 0
                    for at, content in members(stream):
                        x = parse(content) | {"path": path, "at": at}
                        if not payloads:
                            x["payload"] = None
                        held += len(x["payload"] or b"") + 200
                        rows.append(x)
                        if held >= 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    kinds = {"path": pa.string(), "at": pa.int64(), "page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    return manifest.select("path").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(run, RECORD)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    back = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False)
    checked = back.withColumn("payload_digest", F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("wrong digest in "), "path"))))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + (i // 4) * 5)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
