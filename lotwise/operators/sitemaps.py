"""Site maps that name other site maps: their addresses, and a breadth-first search that takes level after level by joins."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, table

QUERIES: dict = {}
ORACLES: dict = {}

#: Site maps that are read of one site, at most (a bound of the operation, not of this library: null reads all), and bytes of one once it is unpacked.
SITEMAPS, UNPACKED = 40, 64 << 20


def robots_sitemaps(robots: Column) -> Column:
    """Addresses of site maps that a robots file names, in order; null and other texts give an empty array."""
    return F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))


def sitemap_text(content: Column) -> Column:
    """A file's text, unpacked if it is gzip. A file that is broken, or larger than UNPACKED once unpacked, is empty."""

    @F.pandas_udf("binary")
    def unpacked(raw: pd.Series) -> pd.Series:
        def one(b: bytes) -> bytes:
            z = zlib.decompressobj(31)
            try:
                text = z.decompress(b, UNPACKED + 1)
            except zlib.error:
                return b""
            return text if z.eof and len(text) <= UNPACKED else b""

        return raw.map(lambda b: None if b is None else one(bytes(b)))

    packed = F.hex(F.substring(content, 1, 2)) == "1F8B"
    return F.make_valid_utf8(F.when(packed, unpacked(F.when(packed, content))).otherwise(content).cast("string"))


def parse_sitemap(text: Column) -> Column:
    """Struct of ``maps`` (addresses of further site maps, if it is an index) and ``pages`` (addresses of pages, if not)."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))

    def plain(s: Column) -> Column:
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            s = F.replace(s, F.lit(entity), F.lit(sign))
        return s

    found = F.transform(found, plain)
    none = F.array().cast("array<string>")
    index = text.rlike(r"(?i)<sitemapindex\b")
    return F.struct(F.when(index, found).otherwise(none).alias("maps"), F.when(index, none).otherwise(found).alias("pages"))


def _numbered(rows: DataFrame, order: list[str], first: int, path: str) -> DataFrame:
    """Rows with ``place`` from ``first`` on in the order of some columns: sorted ranges, numbered by how many rows are in those before."""
    spark = rows.sparkSession
    told = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    told = told.withColumn("_id", F.monotonically_increasing_id())
    told.write.parquet(path)
    told = spark.read.schema(told.schema).parquet(path).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["_part"], r["count"]) for r in told.groupBy("_part").count().collect())  # a row for each range
    starts, upto = [], first
    for part, count in sizes:
        starts.append((part, upto))
        upto += count
    start = spark.createDataFrame(starts, "_p long, _start long")
    return told.join(F.broadcast(start), F.col("_part") == F.col("_p")).withColumn("place", F.col("_start") + F.col("_at")).drop("_id", "_part", "_at", "_p", "_start")


def breadth_first(start: DataFrame, links: DataFrame, most: int | None = None, path: str | None = None) -> DataFrame:
    """(node, level, place) of what ``start`` (node, pos) reaches by ``links`` (source, pos, target), in the order of a queue.

    A level's nodes are those that the one before links to and that no level has, in the order of the linking node and
    of the link in it; the first mention counts. With ``most`` the first so many of the queue are taken. Each level is
    a join, an anti-join with what was seen, and a written table; the search ends when a level is empty. Null nodes are
    none, cycles and links to oneself lead nowhere new, equal positions go by the node.
    """
    spark = start.sparkSession
    path = path or scratch(spark, "levels")
    out = "node string, level int, place long"
    found = start.where("node is not null").groupBy("node").agg(F.min("pos").cast("long").alias("by")).withColumn("pos", F.lit(0).cast("long"))
    level, count = 0, 0
    spark.createDataFrame([], out).write.parquet(f"{path}/seen/none")
    while True:
        now = _numbered(found.select("node", "by", "pos"), ["by", "pos", "node"], count, f"{path}/order-{level}").select("node", F.lit(level).alias("level"), "place")
        if most is not None:
            now = now.where(F.col("place") < most)
        now.write.parquet(f"{path}/seen/{level}")
        front, seen = (spark.read.schema(out).parquet(f"{path}/seen/{part}") for part in (level, "*"))
        size = front.count()
        count += size
        if not size or (most is not None and count >= most):
            return seen
        near = links.where("target is not null").select("source", "pos", "target").join(front.select(F.col("node").alias("_n"), "place"), F.col("source") == F.col("_n"))
        first = near.groupBy(F.col("target").alias("node")).agg(F.min(F.struct(F.col("place").alias("by"), F.col("pos").cast("long").alias("pos"))).alias("x")).select("node", "x.by", "x.pos")
        found = first.join(seen.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
        level += 1


def sitemap_search(start: DataFrame, files: DataFrame, most: int | None = SITEMAPS) -> tuple[DataFrame, DataFrame]:
    """(maps, pages): the site maps that ``start`` (node, pos) reaches among ``files`` (url, content), and the addresses of pages in them (map, pos, page).

    A file that is missing or broken is reached and names nothing.
    """
    parsed = files.select("url", parse_sitemap(sitemap_text(F.col("content"))).alias("x"))
    path = scratch(files.sparkSession, "sitemaps")
    parsed.write.parquet(path)
    parsed = files.sparkSession.read.schema(parsed.schema).parquet(path)
    maps = breadth_first(start, parsed.select(F.col("url").alias("source"), F.posexplode("x.maps").alias("pos", "target")), most)
    pages = parsed.join(maps.select(F.col("node").alias("_n")), F.col("url") == F.col("_n"), "left_semi").select(F.col("url").alias("map"), F.posexplode("x.pages").alias("pos", "page"))
    return maps, pages


def site_levels(spark, sf_dir: str) -> DataFrame:
    """Links of all pages as a graph, each leading to the next one of its page, searched from the first page's links."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("l")).where(F.size("l") > 0)
    steps = F.posexplode(F.transform("l", lambda x, i: F.struct(x.alias("source"), F.get("l", i + 1).alias("target"))))
    links = pages.select("page_id", "l", steps.alias("at", "x")).select("x.source", (F.col("page_id") * 100_000 + F.col("at")).alias("pos"), "x.target").where("target is not null")
    first = pages.agg(F.min_by("l", "page_id").alias("l")).select(F.posexplode("l").alias("pos", "node"))
    return breadth_first(first, links).select("node", "level")


QUERIES["site_levels"] = site_levels
ORACLES["site_levels"] = """
WITH RECURSIVE p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages WHERE regexp_matches(html, 'href="([^"]*)"')),
e AS (SELECT DISTINCT l[i] AS source, l[i + 1] AS target FROM p, unnest(range(1, len(l))) AS u(i)),
r AS (SELECT DISTINCT unnest(l) AS node, 0 AS level FROM (SELECT l FROM p ORDER BY page_id LIMIT 1) f UNION SELECT e.target, r.level + 1 FROM r JOIN e ON e.source = r.node WHERE r.level < 40)
SELECT node, min(level) AS level FROM r GROUP BY node"""
