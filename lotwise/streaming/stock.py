"""Stock changes as a stream: the batch operator's twin, with the last snapshot of each item as state.

State that no snapshot can refer to any more is dropped, and snapshots that come too late are set apart, not lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import scratch
from ..operators.market import FRESH

QUERIES: dict = {}
ORACLES: dict = {}
OUT = "event_id long, stock long, sold long, listed long"
LATE = "user_id long, event_type string, us long, event_id long, stock long"
#: Seconds that an item may lag behind the newest snapshot of all before its state is dropped (beyond the time for which it is fresh).
LATENESS = 86_400
STATE = "user_id long, event_type string, us long, event_id long, stock long"


def batch_changes(rows: DataFrame, held: DataFrame, fresh_seconds: int = FRESH, lateness: int = LATENESS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """OUT of the snapshots of a micro-batch, the last snapshot of each item (STATE) after it, and the late ones; ``held`` are those before it.

    A snapshot is late if its item has a newer one in ``held``. An item's state is dropped when it is older than the
    newest of all by more than ``fresh_seconds`` and ``lateness`` together: then it says nothing about a snapshot that
    isn't itself late by that much.
    """
    both = rows.select("user_id", "event_type", "us", "event_id", "stock", F.lit(1).alias("new")).unionByName(held.withColumn("new", F.lit(0)))
    item = Window.partitionBy("user_id", "event_type")
    w = item.orderBy("us", "event_id", "new")
    told = both.withColumns({
        "d": F.col("stock") - F.lag("stock").over(w),
        "gap": F.col("us") - F.lag("us").over(w),
        # the state's snapshot is still to come in the order: too late
        "late": F.min("new").over(item) < F.min("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    fresh = (F.col("gap") <= fresh_seconds * 1_000_000) & F.col("d").isNotNull()
    out = told.where("new = 1 AND NOT late").select("event_id", "stock", F.when(fresh, F.greatest(-F.col("d"), F.lit(0))).alias("sold"), F.when(fresh, F.greatest("d", F.lit(0))).alias("listed"))
    last = both.groupBy("user_id", "event_type").agg(F.max(F.struct("us", "event_id", "new", "stock")).alias("x")).select("user_id", "event_type", "x.us", "x.event_id", "x.stock")
    newest = both.agg(F.max("us").alias("_newest"))  # one row
    last = last.crossJoin(F.broadcast(newest)).where(F.col("us") >= F.col("_newest") - (fresh_seconds + lateness) * 1_000_000).drop("_newest")
    return out, last, told.where("new = 1 AND late").select("user_id", "event_type", "us", "event_id", "stock")


def stream_changes(snapshots: DataFrame, path: str, fresh_seconds: int = FRESH) -> DataFrame:
    """Streaming snapshots (event_id, user_id, event_type, ts, stock) to event_id, stock, sold and listed, until the stream ends.

    Snapshots of an item are taken in order of (ts, event_id) within a micro-batch, whatever its size; an older one than
    the state's comes too late: it goes to ``path``/late. Results and state are written below ``path``. A micro-batch reads the
    state of the one before and writes its own beside it, so that it can be run again.
    """
    spark = snapshots.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        held = own.read.schema(STATE).parquet(f"{path}/last-{(number - 1) % 2}") if number else own.createDataFrame([], STATE)
        out, last, late = batch_changes(batch, held, fresh_seconds)
        late.write.mode("overwrite").parquet(f"{path}/late/{number}")
        out.write.mode("overwrite").parquet(f"{path}/out/{number}")
        last.write.mode("overwrite").parquet(f"{path}/last-{number % 2}")

    spark.createDataFrame([], OUT).write.mode("overwrite").parquet(f"{path}/out/none")
    rows = snapshots.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "event_type", "event_id", "us", "stock")
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}/out/*")


def stock_delta_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the table as a stream that ends (availableNow); the same rows as stock_delta."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream reads folders: the file by its name, or the parts of a folder
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    events = source.select("event_id", "user_id", "event_type", "ts", F.floor("value").cast("long").alias("stock"))
    return stream_changes(events, scratch(spark, "stock"))


QUERIES["stock_delta_stream"] = stock_delta_stream
