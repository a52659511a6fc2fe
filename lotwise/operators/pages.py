"""Page queries: titles, links, stripped text, and counts of lines and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def page_title_meta(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<meta ")).cast("long").alias("metas"))


QUERIES["page_title_meta"] = page_title_meta
ORACLES["page_title_meta"] = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<meta '))::BIGINT AS metas FROM pages"


def page_links(spark, sf_dir):
    """Distinct link targets of a page with the place of the first."""
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("at", "url"))
    return links.groupBy("page_id", "url").agg(F.min("at").cast("long").alias("at"))


QUERIES["page_links"] = page_links
ORACLES["page_links"] = """
SELECT page_id, url, min(i)::BIGINT AS at FROM (SELECT page_id, unnest(l) AS url, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)) GROUP BY 1, 2"""


def html_strip_native(spark, sf_dir):
    """Text of a page: without scripts, styles and tags, white space squeezed."""
    t = F.regexp_replace(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>", " "), r"(?s)<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.btrim(F.regexp_replace(t, r"[ \t\n\r]+", " ")), 256).alias("text_sha256"))


QUERIES["html_strip_native"] = html_strip_native
ORACLES["html_strip_native"] = r"""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text_sha256 FROM pages"""


def line_words(spark, sf_dir):
    """Lines of each conversation turn that are not empty, with their words."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    return lines.where(F.length(F.btrim("t")) > 0).groupBy("conv_id", "turn").agg(F.count("*").alias("lines"), F.sum(F.regexp_count("t", F.lit("[^ \t\r]+"))).cast("long").alias("words"))


QUERIES["line_words"] = line_words
ORACLES["line_words"] = r"""
SELECT conv_id, turn, count(*) AS lines, sum(len(regexp_extract_all(t, '[^ \t\r]+')))::BIGINT AS words FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM conversations) WHERE length(trim(t)) > 0 GROUP BY 1, 2"""
