"""Sales of the last 48 hours as a stream: each snapshot of an item with what was sold and listed since the one before, and in the hours kept.

The state of an item is its last snapshot and the changes of the hours kept. The watermark ends it: once nothing that
is still to come can refer to it, a timer clears it. No snapshot is dropped: one that comes after a newer one of its item,
however late, goes to its own output.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from json import dumps, loads

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.common import scratch
from ..operators.market import ORACLES as _MARKET_SQL
from .products import _rocks

QUERIES: dict = {}
ORACLES: dict = {}

#: Hours of changes that are kept, polls after which a snapshot says nothing about the next, but seconds for which it always does.
KEPT_HOURS, POLLS, ALWAYS = 48, 3, 1_800
#: A snapshot: ``complete`` says that all of its market was read; ``interval`` is the market's seconds between polls.
SNAPSHOT = "market string, item string, at_us long, id long, stock long, complete boolean, interval long"
OUT = "market string, item string, id long, at_us long, stock long, sold long, listed long, sold_kept long, listed_kept long, late boolean"
OUT_NUMBERS = [c.split()[0] for c in OUT.split(", ") if c.endswith(" long")]
_HOUR = 3_600_000_000
#: Rows of an item that go out in one text.
TOGETHER = 1_000


class StockHistory(StatefulProcessor):
    """Per (market, item): the last snapshot with the changes of the hours kept, in one value, as each call costs more than what it carries."""

    def __init__(self, fresh: int | None = None):
        self.fresh = fresh  # seconds; null: by the market's interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long, id long, stock long, complete boolean, timer long, kept array<struct<at_us: long, sold: long, listed: long>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        last, before, kept = (held[:4], held[4], deque(tuple(x) for x in held[5])) if held else (None, None, deque())
        sums, most = [sum(x[k] for x in kept) for k in (1, 2)], 0
        told = []
        for at, number, stock, complete, interval in sorted((loads(r[2]) for r in rows), key=lambda r: r[:2]):
            if len(told) == TOGETHER:
                yield Row(market=key[0], item=key[1], told=dumps(told))
                told = []
            if last and (at, number) < (last[0], last[1]):
                told.append((number, at, stock, None, None, None, None, 1))
                continue
            fresh = self.fresh if self.fresh is not None else max(POLLS * (interval or 0), ALWAYS)
            most = max(most, fresh)
            sold = listed = None
            if last and last[3] and complete and last[2] is not None and stock is not None and at - last[0] <= fresh * 1_000_000:
                sold, listed = max(last[2] - stock, 0), max(stock - last[2], 0)
                kept.append((at, sold, listed))
                sums = [sums[0] + sold, sums[1] + listed]
            while kept and kept[0][0] < at - KEPT_HOURS * _HOUR:
                _, gone, came = kept.popleft()
                sums = [sums[0] - gone, sums[1] - came]
            # a market that was read in part tells the stock of what it read, and nothing about the rest
            last = (at, number, stock, bool(complete))
            told.append((number, at, stock, sold, listed, *(sums if kept else (None, None)), 0))
        yield Row(market=key[0], item=key[1], told=dumps(told))
        if not last:
            return
        # nothing refers to the last snapshot once it is neither fresh nor are its changes kept
        ends = (last[0] + max(KEPT_HOURS * _HOUR, most * 1_000_000)) // 1_000 + 1
        if before != ends:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        self.last.update((*last, ends, list(kept)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def follow_stock(snapshots: DataFrame, path: str, lateness: int = 86_400, fresh: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, late) of streaming snapshots (SNAPSHOT), until the stream ends; started again on the same path it goes on.

    Each snapshot with ``sold`` and ``listed`` since the one before of its item, null unless both are complete, both
    have a stock and the gap is at most ``fresh`` seconds (by default three intervals of the market, or half an hour),
    and with their sums over the KEPT_HOURS up to it, bounds included, null if there is no change in them. Snapshots
    of one item are taken in order of (at_us, id) within a micro-batch, of one time one after another; one that is
    older than the item's last is in ``late``, as it came. ``lateness`` is how many seconds an item may lag behind the newest of all before its state is
    cleared: after that, a snapshot of it is a first one. Null market is a market, null item an item, null stock
    ends and begins no change; a null time or id leaves the row out. A task holds the snapshots of one item in one
    micro-batch, and the changes of the hours kept.
    """
    spark = snapshots.sparkSession
    rows = snapshots.where("at_us is not null and id is not null").withColumn("time", F.timestamp_micros("at_us")).withWatermark("time", f"{lateness} seconds")
    # without the watermark's own column no row is dropped as late; the timers still go by the watermark. Rows come and go
    # as texts of numbers: the state's worker takes each value of a row singly, which costs more than the rule
    rows = rows.select("market", "item", F.to_json(F.array("at_us", "id", "stock", F.col("complete").cast("long"), "interval")).alias("row"))
    told = rows.groupBy("market", "item").transformWithState(StockHistory(fresh), "market string, item string, told string", "Append", "EventTime")
    told = told.select("market", "item", F.explode(F.from_json("told", "array<array<bigint>>")).alias("x"))
    told = told.select("market", "item", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(OUT_NUMBERS)], (F.get("x", F.lit(len(OUT_NUMBERS))) == 1).alias("late"))
    with _rocks(spark):
        query = told.writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.schema(OUT).parquet(f"{path}/changes")
    return out.where("not late").drop("late"), out.where("late").select("market", "item", "id", "at_us", "stock")


def sold_48h_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the table as a stream that ends; the rows of sold_listed_48h."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    seen = events.select(F.col("event_type").alias("market"), F.col("user_id").cast("string").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("id"), F.floor("value").cast("long").alias("stock"), F.lit(True).alias("complete"), F.lit(28_800).cast("long").alias("interval"))
    changes, _ = follow_stock(seen, scratch(spark, "history"))
    return changes.select(F.col("id").alias("event_id"), F.col("sold_kept").alias("sold_48h"), F.col("listed_kept").alias("listed_48h"))


QUERIES["sold_48h_stream"] = sold_48h_stream
ORACLES["sold_48h_stream"] = _MARKET_SQL["sold_listed_48h"]
