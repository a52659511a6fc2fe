"""Card fragments against a tree built by html.parser, on the pages of the smallest tables and on hand-made ones."""

import html
import re
import time
from html.parser import HTMLParser

import pytest

from lotwise.operators import fragments
from lotwise.operators.fragments import CHROME, CLOSED_BY, ENDS_PARAGRAPH, HIDDEN, ITEM, TOP, VOID, Elements, card_fragments, lines_of

LINK = re.compile("(?s)(.+)")


class Tree(HTMLParser):
    """Nested dicts by html.parser, with the places of tags; a card is found by walking up with sets."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.page, self.line = page, [0]
        for part in page.split("\n"):
            self.line.append(self.line[-1] + len(part) + 1)
        self.root = {"tag": None, "start": 0, "stop": len(page), "up": None, "ids": set(), "text": []}
        self.stack, self.links, self.hidden = [self.root], [], None
        self.feed(page)
        self.close()

    def here(self):
        row, column = self.getpos()
        return self.line[row - 1] + column

    def end(self, place):
        self.stack.pop()["stop"] = place

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in HIDDEN:
            self.hidden = tag
            return
        top = self.stack[-1]["tag"]
        if top in CLOSED_BY.get(tag, "").split() or (top == "p" and tag in ENDS_PARAGRAPH):
            self.end(self.here())
        if tag in VOID:
            return
        node = {"tag": tag, "start": self.here(), "stop": len(self.page), "up": self.stack[-1], "ids": set(), "text": []}
        self.stack.append(node)
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.links.append((node, href))
            for n in self.stack:
                n["ids"].add(href)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag in [n["tag"] for n in self.stack]:
            while self.stack[-1]["tag"] != tag:
                self.end(self.here())
            self.end(self.page.index(">", self.here()) + 1)

    def handle_data(self, data):
        for n in self.stack if not self.hidden else ():
            n["text"].append(html.unescape(data))

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def cards(self):
        text = lambda n: re.sub(r"\s", "", "".join(n["text"]))
        price, lots = (lambda n: len(re.findall("₽|руб", text(n)))), (lambda n: "лот" in text(n))
        for node, href in self.links:
            while True:
                up = node["up"]
                above, n = [], up
                while n:
                    above.append(n["tag"])
                    n = n["up"]
                if up["tag"] is None or up["tag"] in TOP or (up["tag"] in CHROME and not ITEM & set(above[1:])) or len(up["ids"]) > 1 or up["stop"] - up["start"] > 50_000 or len(text(up)) > 600:
                    break
                if price(node) and (lots(node) or price(up) > price(node)):
                    break
                node = up
            yield href, node["start"], node["stop"], len(text(node))


def plain(page):
    return list(Tree(page).cards())


def fast(page):
    e = Elements.of(page, LINK)
    return [(link, e.start[c], e.stop[c], e.shown(c, 0)) for (_, link), c in zip(e.links, e.cards(), strict=True)]


PAGES = [
    "<main><ul><li><div><b>114 ₽</b></div><a href='/x'>Knife</a><i>674 лота</i></li><li><a href=/y>Gun</a><b>5 руб</b></li></ul></main>",
    "<div><div class='c'><a href='/1'><img src=x></a><p>Seer<p>от 3 ₽<p><a href='/1'>Seer</a></div><div><a href='/2'>Bat</a> 9 ₽</div></div>",
    "<header>Buy <a href='/h'>now</a> 5 ₽</header><article><header><a href='/a'>A</a></header><footer>7 ₽ 3 лота</footer></article>",
    "<table><tr><td>A<td><a href='/a?x=1&amp;y=2'>A</a><tr><td>B<td><a href='/b'>B</a></table>",
    "<div>banner from 500 ₽<div><a href='/a'>A</a><b>3 ₽</b></div></div>",
    "<p>one<div><a href='/1'>a</a></p></b></div></div></div><span><a href='/2'>b",
    "<div title='a > b'><a title=\"it's\" href='/q'>q</a></div><script>var t='<a href=\"/no\">';</script><!-- <a href='/no'> --><a data-href='/no' href='/yes'>y</a>",
    "<div><a href='/long'>x</a>" + "word " * 200 + "</div>",
    "<nav><ul><li><a href='/n1'>n</a></ul></nav><aside><div><a href='/s'>s</a> 2 ₽</div></aside>",
    "no tags at all < 3 & > 2", "", "<a href='/only'>", "<div><a href=''>none</a><a>none</a></div>",
]


@pytest.mark.parametrize("page", PAGES)
def test_cards_of_hand_made_pages(page):
    assert fast(page) == plain(page)


def test_cards_say_what_the_rules_say():
    page = PAGES[0]
    card = lambda p: [p[a:b] for _, a, b, _ in fast(p)]
    assert card(page)[0].startswith("<li><div><b>114") and card(page)[0].endswith("674 лота</i></li>")
    assert card(PAGES[4]) == ["<div><a href='/a'>A</a><b>3 ₽</b></div>"]  # the banner's price is another's
    assert card(PAGES[7]) == ["<a href='/long'>x</a>"]  # more text than a card has
    assert card(PAGES[2])[0] == "<a href='/h'>now</a>" and card(PAGES[2])[1].startswith("<article>")
    grid = "<div><a href='/p/Seer-1'>pic</a><a href='/p/seer-1/'>Seer</a> 3 ₽ 2 лота</div>"
    e = Elements.of(grid, re.compile("(/p/.*)"))
    assert {e.start[c] for c in e.cards(re.compile("/p/.*"))} == {0}  # two spellings of one product


def test_cards_of_the_pages_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted((r.page_id, r.place, r.link, r.start, r.stop, r.visible) for r in card_fragments(pages).collect())
    want = sorted((r.page_id, k, *x) for r in pages.collect() for k, x in enumerate(plain(r.html or "")))
    assert got == want and len(got) > 100


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, PAGES[0], 0), (3, PAGES[0], 0), (3, PAGES[0], 0)]
    pages = spark.createDataFrame(rows, "page_id long, html string, place int").withColumnRenamed("place", "link")
    got = card_fragments(pages).collect()
    assert sorted(str(r.page_id) for r in got) == ["3", "3", "3", "3", "None", "None"]
    assert got[0].lines == ["114 ₽", "Knife", "674 лота"] and got[0].fragment.startswith("<li>")
    assert card_fragments(pages.limit(0)).count() == 0


def test_lines():
    assert lines_of("<i>114</i><b>230,71 ₽</b>") == ["114", "230,71 ₽"] == lines_of("<i>114</i> <b>230,71 ₽</b>")
    assert lines_of("1<span>,</span>320") == ["1,320"] and lines_of("от <b>328</b> ₽") == ["от 328 ₽"]
    assert lines_of("<i>a</i><!-- x --><b>b</b>") == ["a", "b"] and lines_of("a<!-- x -->b") == ["ab"] and lines_of("a<script>1</script>b") == ["a b"]
    assert lines_of("<p>&lt;b&gt;&nbsp;x\n  y<br>z</p>") == ["<b> x", "y", "z"] and lines_of("") == []


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "<a href='/x'>x</a>", "<div><a href='/x'>" * 25_000, "<b>" * 30_000 + "</i>" * 30_000 + "<a href='/x'>x</a>", "<a \"" * 50_000 + "<script>" * 50_000 + "<!--", "<" * 200_000, "<div><a href='/x'></a>" * 30_000])
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.time()
    e = Elements.of(page, LINK)
    e.cards()
    assert time.time() - began < 5
    assert fragments.lines_of(page) is not None
