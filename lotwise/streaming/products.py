"""What a marketplace knows of its products, as state over polls.

Observations (of a list, a page, a browser's view, a sitemap) are folded in the order of time into one record for each
product. A product is known by its link or, where a source gives none, by its name; both come to the same group of
state, so a record by name goes into that of the link as soon as the link is seen. The state holds the records and the
products that are gone. It ends by event time: what nothing confirms for a week is forgotten, and so is a product that
has been gone for three days.
"""

from __future__ import annotations

import contextlib
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, replace
from json import loads

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import name_key
from ..operators.common import scratch

QUERIES: dict = {}
ORACLES: dict = {}

#: Fixed values, in seconds: how long a price that the browser shows holds against other sources, the least time from the first miss of a page to its end, how
#: long a gone product is remembered, after how long a link to it is looked at again, and after how long an unseen product is forgotten.
SHOWN, MISSING, GONE, AGAIN, FORGOTTEN = 1_800, 43_200, 259_200, 21_600, 604_800
#: Misses in a row after which a product can be gone, and the sources with their own rules.
MISSES, BROWSER, PAGE = 3, "browser", "page"
#: Columns of an observation. ``poll`` numbers the polls, ``seq`` orders what is of one second, ``missing`` says that a page is not there.
SEEN = "market string, poll long, at long, seq long, source string, name string, link string, price double, lots int, missing boolean"
RECORD = "name string, link string, price double, lots int, source string, at long, seen long, born long, shown_at long, shown_lots boolean, misses int, missing_since long, priced_in long, listed_in long, whole_in long"
OUT = "market string, key string, product string, status string, name string, link string, price double, lots int, source string, at long, seen long, misses int, seq long, step long"
_ID, _SLUG = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "(?i)/product/([a-z0-9-]+)/"

#: What the fold reads of an observation: texts and numbers, which come to the state's worker as one text.
TEXTS, NUMBERS = ("product", "source", "name", "link", "slug_name", "name_key"), ("at", "seq", "poll", "lots")
Seen = namedtuple("Seen", [*NUMBERS, *TEXTS, "price", "missing", "key"])


@dataclass
class Record:
    name: str | None = None
    link: str | None = None
    price: float | None = None
    lots: int | None = None
    source: str | None = None
    at: int | None = None
    seen: int = 0
    born: int = 0
    shown_at: int | None = None
    shown_lots: bool = False
    misses: int = 0
    missing_since: int | None = None
    priced_in: int | None = None  # polls that set the price, that set it from a list, that gave price and lots
    listed_in: int | None = None
    whole_in: int | None = None


class Shelf:
    """The records of one name and the products that are gone; ``touched`` says what changed, and how."""

    def __init__(self, records: dict[str, Record] | None = None, gone: dict[str, int] | None = None):
        self.records, self.gone, self.touched = records or {}, gone or {}, {}

    def forget(self, now: int) -> None:
        for key in [k for k, r in self.records.items() if now - r.seen > FORGOTTEN]:
            del self.records[key]
            self.touched[key] = "forgotten"
        self.gone = {k: at for k, at in self.gone.items() if now - at < GONE}

    def ends(self) -> int | None:
        """When the next of them has to be looked at."""
        return min([r.seen + FORGOTTEN + 1 for r in self.records.values()] + [at + GONE for at in self.gone.values()], default=None)

    def _key(self, seen: Seen) -> tuple[str, bool]:
        if seen.product:
            return seen.product, False
        linked = sorted((r.born, k) for k, r in self.records.items() if not k.startswith("name:"))
        return (linked[0][1] if linked else f"name:{seen.key}"), True

    def add(self, seen: Seen) -> None:
        self.forget(seen.at)
        key, by_name = self._key(seen)
        if seen.missing:
            self._miss(key, seen)
            return
        if key in self.gone:
            if seen.price is not None or seen.lots is not None or seen.source == PAGE:
                del self.gone[key]  # on sale again, or its page is there again
            elif key not in self.records and seen.at - self.gone[key] < AGAIN:
                return
        record = self.records.setdefault(key, Record(born=seen.at))
        record.seen, record.link = seen.at, seen.link or record.link
        if seen.source == PAGE:
            record.misses, record.missing_since = 0, None
        if seen.name and (seen.name_key == seen.key or not record.name):
            record.name = seen.name
        elif not record.name:
            record.name = seen.slug_name
        if not by_name:
            self._merge(f"name:{seen.key}", record)
        self._tell(record, seen, by_name)
        self.touched[key] = "known"

    def _merge(self, twin: str, record: Record) -> None:
        """A record by name goes into the link's."""
        old = self.records.pop(twin, None)
        if old is None:
            return
        self.touched[twin] = "merged"
        if (old.at or 0) > (record.at or 0):
            for field in ("price", "lots", "at", "source"):
                if getattr(old, field) is not None:
                    setattr(record, field, getattr(old, field))
        for mark in ("priced_in", "listed_in", "whole_in"):
            setattr(record, mark, max(getattr(old, mark), getattr(record, mark), key=lambda x: -1 if x is None else x))

    def _tell(self, record: Record, seen: Seen, by_name: bool) -> None:
        price, lots, shown = seen.price, seen.lots, seen.source == BROWSER
        if not shown and record.shown_at is not None and seen.at - record.shown_at < SHOWN:
            price, lots = None, None if record.shown_lots else lots
        if by_name and price is not None and record.priced_in == seen.poll and record.price is not None:
            price = min(price, record.price)  # another lot of that name does not raise this poll's price
        if by_name and record.whole_in == seen.poll:
            lots = None
        if price is not None or lots is not None:
            record.misses, record.missing_since = 0, None
        if lots == 0:
            price, record.price, record.at = None, None, seen.at
        if price is not None:
            record.price, record.at, record.source, record.priced_in = price, seen.at, seen.source, seen.poll
            if seen.source != PAGE:
                record.listed_in = seen.poll
            if seen.lots is not None:
                record.whole_in = seen.poll
        if lots is not None:
            record.lots, record.at = lots, record.at or seen.at
        if shown and (seen.price is not None or seen.lots is not None):
            record.shown_at, record.shown_lots = seen.at, seen.lots is not None

    def _miss(self, key: str, seen: Seen) -> None:
        record = self.records.get(key)
        if record is None or record.listed_in == seen.poll:
            return  # a list of this poll knows better
        record.misses, record.missing_since = record.misses + 1, seen.at if record.missing_since is None else record.missing_since
        record.price, record.lots, record.at = None, None, seen.at
        self.touched[key] = "known"
        if key in self.gone or (record.misses >= MISSES and seen.at - record.missing_since >= MISSING):
            del self.records[key]
            self.gone[key] = seen.at
            self.touched[key] = "gone"


class ProductState(StatefulProcessor):
    """Shelf per (market, key) as state variables: a map of records, a map of gone products, and the last observation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "product string", RECORD)
        self.gone = handle.getMapState("gone", "product string", "at long")
        self.last = handle.getValueState("last", "at long, seq long, step long, timer long")

    def _load(self) -> tuple[Shelf, list]:
        records = {k[0]: Record(*v) for k, v in self.records.iterator()} if self.records.exists() else {}
        gone = {k[0]: v[0] for k, v in self.gone.iterator()} if self.gone.exists() else {}
        return Shelf(records, gone), list(self.last.get()) if self.last.exists() else [None, None, 0, None]

    def _store(self, key: tuple, shelf: Shelf, before: Shelf, last: list) -> Iterator[Row]:
        for product, status in shelf.touched.items():
            record = shelf.records.get(product)
            if record is not None:
                self.records.updateValue((product,), tuple(asdict(record).values()))
            elif product in before.records:
                self.records.removeKey((product,))
            last[2] += 1
            record = record or replace(before.records.get(product, Record()), price=None, lots=None)
            yield Row(market=key[0], key=key[1], product=product, status=status, name=record.name, link=record.link, price=record.price, lots=record.lots, source=record.source, at=record.at, seen=record.seen, misses=record.misses, seq=None, step=last[2])
        for product in before.gone.keys() - shelf.gone.keys():
            self.gone.removeKey((product,))
        for product, at in shelf.gone.items():
            self.gone.updateValue((product,), (at,))
        ends = shelf.ends()
        if ends is None and last[0] is None:
            return
        if ends != last[3]:
            if last[3] is not None:
                self.handle.deleteTimer(last[3] * 1000)
            if ends is not None:
                self.handle.registerTimer(ends * 1000)
            last[3] = ends
        if ends is None:
            self.last.clear()
        else:
            self.last.update(tuple(last))

    @staticmethod
    def _seen(key: str, rows: Iterator[Row]) -> Iterator[Seen]:
        once: dict = {}  # a text that repeats is held once
        for row in rows:
            told = loads(row[3])
            numbers = [None if x is None else int(x) for x in told[:4]]
            yield Seen(*numbers, *[once.setdefault(x, x) for x in told[4:10]], None if told[10] is None else float(told[10]), told[11] == "true", key)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        shelf, last = self._load()
        before = Shelf(dict(shelf.records), dict(shelf.gone))
        shelf.records = {k: replace(r) for k, r in shelf.records.items()}
        # the observations of one name in one micro-batch, in order
        for seen in sorted(self._seen(key[1], rows), key=lambda r: r[:2]):
            if last[0] is not None and (seen.at, seen.seq) < (last[0], last[1]):
                last[2] += 1
                yield Row(market=key[0], key=key[1], product=seen.product, status="late", name=seen.name, link=seen.link, price=seen.price, lots=seen.lots, source=seen.source, at=seen.at, seen=None, misses=None, seq=seen.seq, step=last[2])
                continue
            shelf.add(seen)
            last[0], last[1] = seen.at, seen.seq
        yield from self._store(key, shelf, before, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        shelf, last = self._load()
        before = Shelf(dict(shelf.records), dict(shelf.gone))
        last[3] = None
        shelf.forget(expiredTimerInfo.getExpiryTimeInMs() // 1000)
        yield from self._store(key, shelf, before, last)

    def close(self) -> None:
        pass


def keyed(seen: DataFrame) -> DataFrame:
    """Observations with product (what the link says, else null), slug_name, name_key and the key of their group.

    The group is the name's key, which a link says in its slug; links without one are a group of their own, and
    observations that have neither link nor name are left out.
    """
    link = F.col("link")
    # what has no key, said of link and name alone: the key's own rules would run twice, before and after this
    seen = seen.where("at is not null").where((F.length(link) > 0) | F.lower("name").rlike("[a-z0-9]"))
    found = F.lower(F.regexp_extract(link, _ID, 0))
    product = F.when(found != "", found).otherwise(F.when(F.length(link) > 0, F.regexp_replace(F.lower(link), "^https?://[^/]+", "")))
    slug = F.regexp_extract(link, _SLUG, 1)
    slug_name = F.when(slug != "", F.replace(slug, F.lit("-"), F.lit(" ")))
    own = F.when(F.length(name_key(F.col("name"))) > 0, name_key(F.col("name")))
    rows = seen.withColumns({"product": product, "slug_name": slug_name, "name_key": own, "missing": F.coalesce("missing", F.lit(False))})
    group = F.coalesce(name_key(F.col("slug_name")), F.when(F.col("product").isNotNull(), F.concat(F.lit("link:"), F.col("product"))), F.col("name_key"))
    return rows.withColumn("key", group).withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """State variables need this store; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def follow_products(seen: DataFrame, path: str) -> DataFrame:
    """Streaming observations (SEEN) to changes of products (OUT), until the stream ends; it goes on where it stopped if it is started again on the same path.

    A change is a product's record after a micro-batch: known, merged (into the link's record), gone or forgotten, with
    ``step`` counting the changes of its group. Observations of one name are taken in order of (at, seq) within a
    micro-batch; one that is older than the last of its name comes too late and is handed on with status late instead.
    What lags a week behind the newest of all is dropped by the watermark: it could only speak of forgotten products.
    Null market is a market of its own, a null price or number of lots says nothing, null seq is 0, null at leaves the
    row out. Memory: the observations of one name in one micro-batch, which the source's limits bound.
    """
    spark = seen.sparkSession
    late = f"{FORGOTTEN} seconds"
    # the state's worker takes each value of a row singly, which costs more than the fold: all of them come as one text
    told = F.to_json(F.array(*[F.col(c).cast("string") for c in (*NUMBERS, *TEXTS, "price", "missing")]))
    rows = keyed(seen).select("market", "key", F.timestamp_seconds("at").alias("time"), told.alias("told")).withWatermark("time", late)
    changes = rows.groupBy("market", "key").transformWithState(ProductState(), OUT, "Append", "EventTime")
    with _rocks(spark):
        query = changes.writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}/changes")


def current_products(changes: DataFrame) -> DataFrame:
    """The last change of each product, without those that are merged, gone or forgotten."""
    last = changes.where("status <> 'late'").groupBy("market", "key", "product").agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("market", "key", "product", "step", "seq")]), "step").alias("x"))
    return last.select("market", "key", "product", "x.*").where("status = 'known'").drop("status")


def product_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, faults): the state itself as a table, and its rows that cannot be right: a negative price or number of
    lots, a price without its source, an end before a beginning, a record by name beside one by link."""
    state = spark.read.format("statestore").option("stateVarName", "records").load(f"{path}/state")
    rows = state.select("key.market", "key.key", F.col("user_map_key.product").alias("product"), "user_map_value.*")
    linked = rows.where("product not like 'name:%'").select(F.col("market").alias("m"), F.col("key").alias("k")).distinct()
    twins = rows.where("product like 'name:%'").join(linked, F.col("market").eqNullSafe(F.col("m")) & (F.col("key") == F.col("k")), "left_semi")
    wrong = rows.where("price < 0 or lots < 0 or (price is not null and (source is null or at is null)) or seen < born or missing_since > at")
    return rows, wrong.unionByName(twins).distinct()


def product_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the table as observations of forty products in a stream that ends; what is known at its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    number = (F.col("user_id") % 40).cast("string")
    uuid = F.regexp_replace(F.md5(number), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    missing = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    seen = events.select(
        F.lit("stand-in").alias("market"), F.floor(at / 10_800).alias("poll"), at.alias("at"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "list").when(F.col("event_type") == "purchase", BROWSER).when(F.col("event_type") == "click", "json").otherwise(PAGE).alias("source"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("Item "), number)).alias("name"),
        F.when((F.col("event_type") != "click") | (F.col("event_id") % 3 == 0), F.concat(F.lit("https://market/product/item-"), number, F.lit("/"), uuid)).alias("link"),
        F.when((F.col("event_id") % 4 > 0) & ~missing, F.col("value")).alias("price"), F.when((F.col("event_id") % 3 > 0) & ~missing, (F.col("event_id") % 6).cast("int")).alias("lots"), missing.alias("missing"),
    )
    return current_products(follow_products(seen, scratch(spark, "products")))


QUERIES["product_state_stream"] = product_state_stream
assert [f.name for f in fields(Record)] == [c.split()[0] for c in RECORD.split(", ")]
