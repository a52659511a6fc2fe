"""Breadth-first search against a queue, and site maps of any kind."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators.sitemaps import breadth_first, parse_sitemap, robots_sitemaps, sitemap_search, sitemap_text


def queue_search(start, links, most=None):
    todo, seen, level = list(start), [], {}
    for n in start:
        level.setdefault(n, 0)
    while todo and (most is None or len(seen) < most):
        n = todo.pop(0)
        if n in seen:
            continue
        seen.append(n)
        for t in links.get(n, []):
            if t is not None:
                level.setdefault(t, level[n] + 1)
                todo.append(t)
    return [(n, level[n], k) for k, n in enumerate(seen)]


@pytest.mark.parametrize("most", [None, 1, 7, 40])
def test_search_equals_a_queue(spark, most):
    r = random.Random(6)
    links = {f"n{k}": [r.choice([f"n{r.randrange(60)}", f"n{k}", "n0", None, f"leaf{r.randrange(9)}"]) for _ in range(r.randrange(4))] for k in range(60)}
    links["n3"], links["chain0"] = ["chain0"], ["chain1"]
    links |= {f"chain{k}": [f"chain{k + 1}"] for k in range(1, 6)}
    start = ["n5", "n3", "n5"]
    rows = [(s, k, t) for s, targets in links.items() for k, t in enumerate(targets)]
    table = spark.createDataFrame(rows, "source string, pos int, target string").withColumn("place", F.lit("clash")).repartition(5)
    got = breadth_first(spark.createDataFrame([*[(n, k) for k, n in enumerate(start)], (None, 9)], "node string, pos int"), table, most).collect()
    assert sorted((x.node, x.level, x.place) for x in got) == sorted(queue_search(start, links, most))


def test_search_of_nothing(spark):
    links = spark.createDataFrame([("a", 0, "b")], "source string, pos int, target string")
    start = spark.createDataFrame([("x", 0)], "node string, pos int")
    assert [tuple(x) for x in breadth_first(start, links).collect()] == [("x", 0, 0)]
    assert breadth_first(start.limit(0), links).count() == 0


def test_nested_and_packed_maps(spark):
    index = lambda *u: "<SitemapIndex>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in u) + "</sitemapindex>"
    pages = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    files = {
        "s/1": index("s/2", "s/3", "s/1").encode(), "s/2": gzip.compress(index("s/4", "s/missing", "s/broken").encode()), "s/3": pages("p/1?a=1&amp;b=2", "p/2").encode(),
        "s/4": gzip.compress(pages("p/3").encode()), "s/broken": gzip.compress(pages("p/4").encode())[:-9], "s/other": pages("p/5").encode(), "s/null": None,
    }
    table = spark.createDataFrame(list(files.items()), "url string, content binary")
    start = spark.createDataFrame([("s/1", 0)], "node string, pos int")
    maps, found = sitemap_search(start, table)
    assert [x.node for x in maps.orderBy("place").collect()] == ["s/1", "s/2", "s/3", "s/4", "s/missing", "s/broken"]
    assert sorted(x.page for x in found.collect()) == ["p/1?a=1&b=2", "p/2", "p/3"]
    maps, found = sitemap_search(start, table, most=2)
    assert [x.node for x in maps.orderBy("place").collect()] == ["s/1", "s/2"] and found.count() == 0
    robots = spark.createDataFrame([("User-agent: *\n Sitemap : s/1\r\nsitemap:s/2",), (None,)], "t string").select(robots_sitemaps(F.col("t")))
    assert [x[0] for x in robots.collect()] == [["s/1", "s/2"], []]
    one = table.where("url = 's/null'").select(parse_sitemap(sitemap_text(F.col("content"))).alias("x")).first().x
    assert one.maps == [] and one.pages == []
