"""Card fragments: for each link of a page the largest element around it that shows nothing but that link's product.

A page becomes a table of elements with their parent, where they open and close, and how much is visible before either.
Elements are in the order in which they open, so one pass from the last to the first tells which links an element
holds, and one from the first to the last how far up a link's card reaches: no recursion, and time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

QUERIES: dict = {}
ORACLES: dict = {}

#: Elements without content, elements whose content is not shown, and those that a following tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg".split())
CLOSED_BY = {"li": "li", "p": "p", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A card reaches up to none of these; not to these either unless they are within an item; items; elements that begin a line.
TOP = frozenset("html body main".split())
CHROME = frozenset("header nav footer aside".split())
ITEM = frozenset("article li".split())
BLOCK = frozenset("address article aside blockquote br button dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr img label li main nav ol option p section select summary table tbody td tfoot th thead tr ul".split())
#: Characters of markup and visible characters (without white space) of a card, at most.
MARKUP, VISIBLE = 50_000, 600
#: Marks of a price and of a number of lots.
PRICE, LOTS = re.compile("₽|руб", re.I), re.compile("лот", re.I)
#: Bytes of fragments that a task holds before it hands them on.
HELD = 4 << 20
OUT = "place int, link string, start int, stop int, visible int, fragment string, lines array<string>"

_NAME, _STOP, _SPACE = re.compile("</?([A-Za-z][A-Za-z0-9:-]*)"), re.compile("[\"'>]"), re.compile(r"\s+")
_HREF = re.compile(r"""(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in HIDDEN}


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; name '' for what is not shown: comments and hidden elements.

    A ``>`` within quotes ends no tag. A quote that is never closed is an ordinary character, a comment that is never
    closed takes the rest of the page, and a hidden element that is never closed is an ordinary one. Nothing is looked
    for again once it was not found.
    """
    at, gone = 0, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        name = _NAME.match(page, start)
        if not name:
            at = start + 1
            continue
        end = name.end()
        while (stop := _STOP.search(page, end)) and stop[0] != ">":
            other = -1 if stop[0] in gone else page.find(stop[0], stop.end())
            if other < 0:
                gone.add(stop[0])
            end = stop.end() if other < 0 else other + 1
        if not stop:
            return  # no tag ends any more
        at, tag, closing = stop.end(), name[1].lower(), page[start + 1] == "/"
        if tag in HIDDEN and not closing and tag not in gone:
            over = _CLOSE[tag].search(page, at)
            if over:
                at = over.end()
                yield start, at, "", False, ""
                continue
            gone.add(tag)
        yield start, at, tag, closing, page[name.end() : stop.start()]


def unquoted(value: str) -> str:
    return entities.unescape(value[1:-1] if value[:1] in "\"'" else value)


@dataclass
class Elements:
    """A page's elements in the order in which they open; number 0 is the page."""

    tag: list = field(default_factory=lambda: [""])
    parent: list = field(default_factory=lambda: [0])
    start: list = field(default_factory=lambda: [0])
    stop: list = field(default_factory=list)
    within_item: list = field(default_factory=lambda: [False])
    before: list = field(default_factory=lambda: [(0, 0, 0)])  # visible characters, prices and lots where it opens
    after: list = field(default_factory=list)
    links: list = field(default_factory=list)  # element, link

    @classmethod
    def of(cls, page: str, link_pattern: re.Pattern) -> Elements:
        self = cls(stop=[len(page)], after=[(0, 0, 0)])
        stack, open_, seen, at = [0], {}, (0, 0, 0), 0

        def text(upto: int) -> None:
            nonlocal seen
            if not page[at:upto].isspace() and upto > at:
                shown = entities.unescape(page[at:upto])
                seen = (seen[0] + len(_SPACE.sub("", shown)), seen[1] + len(PRICE.findall(shown)), seen[2] + len(LOTS.findall(shown)))

        def close(place: int) -> None:
            e = stack.pop()
            open_[self.tag[e]] -= 1
            self.stop[e], self.after[e] = place, seen

        for start, end, tag, closing, attributes in tags(page):
            text(start)
            at = end
            if not tag:
                continue
            if closing:
                if open_.get(tag):
                    while self.tag[stack[-1]] != tag:
                        close(start)
                    close(end)
                continue
            top = self.tag[stack[-1]]
            if top in CLOSED_BY.get(tag, "").split() or (top == "p" and tag in ENDS_PARAGRAPH):
                close(start)
            if tag in VOID:
                continue
            e, up = len(self.tag), stack[-1]
            self.tag.append(tag)
            self.parent.append(up)
            self.start.append(start)
            self.stop.append(len(page))
            self.before.append(seen)
            self.after.append(seen)
            self.within_item.append(self.within_item[up] or self.tag[up] in ITEM)
            stack.append(e)
            open_[tag] = open_.get(tag, 0) + 1
            if tag == "a" and (href := _HREF.search(attributes)) and (found := link_pattern.match(unquoted(href[1]))):
                self.links.append((e, found[1] if found.re.groups else found[0]))
        text(len(page))
        while len(stack) > 1:
            close(len(page))
        self.after[0] = seen
        return self

    def shown(self, e: int, k: int) -> int:
        return self.after[e][k] - self.before[e][k]

    def cards(self, product: re.Pattern | None = None) -> list[int]:
        """For each link the element that is its card. ``product`` finds in a link what tells products apart; by default the whole link does."""
        number: dict[str, int] = {}
        name = lambda link: (product.search(link)[0] if product and product.search(link) else link).lower().rstrip("/")
        low, high = [len(self.links)] * len(self.tag), [-1] * len(self.tag)  # the smallest and largest product within
        for e, link in self.links:
            k = number.setdefault(name(link) if product else link, len(number))
            low[e], high[e] = min(low[e], k), max(high[e], k)
        for e in range(len(self.tag) - 1, 0, -1):
            up = self.parent[e]
            low[up], high[up] = min(low[up], low[e]), max(high[up], high[e])
        card = list(range(len(self.tag)))
        for e in range(1, len(card)):
            up = self.parent[e]
            barred = up == 0 or self.tag[up] in TOP or (self.tag[up] in CHROME and not self.within_item[up])
            crowded = low[up] < high[up] or self.stop[up] - self.start[up] > MARKUP or self.shown(up, 0) > VISIBLE
            full = self.shown(e, 1) > 0 and (self.shown(e, 2) > 0 or self.shown(up, 1) > self.shown(e, 1))
            if high[e] >= 0 and not (barred or crowded or full):
                card[e] = up
        # a link's way up ends where an element stays; ways that meet go on together
        out, top = [], {}
        for e, _ in self.links:
            way = []
            while e not in top and card[e] != e:
                way.append(e)
                e = card[e]
            end = top.get(e, e)
            top.update(dict.fromkeys(way, end))
            out.append(end)
        return out


def lines_of(markup: str) -> list[str]:
    """The visible lines of a fragment. Tags next to each other part labels, and so do an end and a start with blanks
    between them, elements that begin a line, and line ends; text around an inline tag stays together, a comment is nothing."""
    out, at, gap, ended = [], 0, "", None  # gap: text since the last tag, which was an end tag if ended
    for start, end, tag, closing, _ in tags(markup):
        gap += markup[at:start]
        at = end
        if not tag:
            gap += "" if markup.startswith("<!--", start) else " "
            continue
        parted = ended is not None and (not gap or (ended and not closing and not gap.strip(" \t\xa0")))
        out += [gap, "\n" if parted or tag in BLOCK else ""]
        gap, ended = "", closing
    lines = (_SPACE.sub(" ", entities.unescape(x)).strip() for x in ("".join(out) + gap + markup[at:]).split("\n"))
    return [x for x in lines if x]


def card_fragments(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", link_pattern: str = "(?s)(.+)", product_pattern: str | None = None) -> DataFrame:
    """Per link of a page: id, place (its number among the page's links), link, start and stop of its card, visible characters, fragment and lines.

    A link is an ``<a>`` whose href, entities resolved, begins with ``link_pattern`` (its first group is the link);
    ``product_pattern`` finds in it what tells products apart. The card is the largest element around the link that
    holds no other product's link, has at most VISIBLE characters that show and MARKUP of markup, and lies within
    headers, menus, footers and side columns unless these are part of an item. It grows no further once it shows a
    price and lots, or where the element above shows another price. Null and empty pages give no row, tags that are
    never closed reach to the end of the page, and repeated rows repeat their links. A page is held in memory with some
    hundred bytes for each tag.
    """
    own = re.compile(link_pattern), re.compile(product_pattern, re.I) if product_pattern else None
    schema = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "place", "link", "start", "stop", "visible", "fragment", "lines"]
        kinds = None
        rows: list[tuple] = []
        held = 0
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            for key, page in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                page = page or ""
                elements = Elements.of(page, own[0])
                told: dict[int, tuple] = {}
                for place, ((_, link), card) in enumerate(zip(elements.links, elements.cards(own[1]), strict=True)):
                    if card not in told:
                        markup = page[elements.start[card] : elements.stop[card]]
                        told = {card: (markup, lines_of(markup))}  # links of one card follow each other
                    markup, lines = told[card]
                    rows.append((key.as_py(), place, link, elements.start[card], elements.stop[card], elements.shown(card, 0), markup, lines))
                    held += 2 * len(markup) + 200
                    if held >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {schema}, {OUT}").withColumnRenamed("id", id_col)


def card_fragments_query(spark, sf_dir: str) -> DataFrame:
    """Every link of every page with its card: where it is, how much it shows, its first line and a digest of its markup."""
    cards = card_fragments(table(spark, sf_dir, "pages"))
    return cards.select("page_id", "place", "link", "start", "stop", "visible", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"), F.sha2("fragment", 256).alias("fragment_sha256"))


QUERIES["card_fragments"] = card_fragments_query
