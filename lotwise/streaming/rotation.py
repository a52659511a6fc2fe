"""A market that is too large for one poll: its pages are read in turn, so many at a time, and what a whole cycle did not show is gone.

Pages land as files; a micro-batch takes as many as a poll reads. The state is the offers, each with the cycle that
showed it last, and one row of progress. A micro-batch reads the state of the one before and writes its own beside it,
so that it can be run again after a failure, and the next start goes on where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pages of a poll, and seconds between polls after which what is known is out of date until a cycle has ended.
PAGES, PAUSE = 15, 10_800
#: A page that was read: ``seq`` orders the pages, ``page`` and ``pages`` are its number and how many the market says it has.
PAGE = "seq long, at long, page int, pages int, offers array<struct<id:string,name:string,kind:string,price:double,quantity:long,seller:string,sold_30d:double>>"
OFFER = "id string, name string, kind string, price double, quantity long, seller string, sold_30d double, cycle long, seq long, pos int"
PROGRESS = "cycle long, done long, refilling boolean, at long"


def read_pages(spark: SparkSession, folder: str, pages: int = PAGES) -> DataFrame:
    """The pages of a folder (Parquet, one a file) as a stream that takes ``pages`` of them at a time."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", pages).parquet(folder)


def turn(read: DataFrame, offers: DataFrame, progress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers and progress after the pages of one poll.

    A page ends a cycle if it is the last that the market says it has, if it shows nothing, or if the market doesn't say;
    then offers that this cycle did not show are gone. Of the mentions of an offer the last counts. A pause of more
    than PAUSE seconds before a page makes what is known out of date (``refilling``) until the next end.
    """
    few = Window.orderBy("seq")  # the pages of a poll: a bounded number of rows
    size = F.coalesce(F.size("offers"), F.lit(0))
    pages = read.where("seq is not null").withColumn("ends", (~F.coalesce((F.col("pages") > 0) & (F.col("page") < F.col("pages")) & (size > 0), F.lit(False))).cast("long"))
    told = pages.crossJoin(F.broadcast(progress.withColumnRenamed("at", "_at")))  # one row
    before = F.coalesce(F.lag("at").over(few), F.col("_at"))
    told = told.withColumns({"before": F.coalesce(F.sum("ends").over(few.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "gap": F.coalesce(F.col("at") - before > PAUSE, F.lit(False))}).withColumn("own", F.col("cycle") + F.col("before"))
    ends = F.max(F.when(F.col("ends") == 1, F.col("seq")))
    gap = F.max(F.when(F.col("gap"), F.col("seq")))
    after = told.groupBy("cycle", "done", "refilling", "_at").agg(F.sum("ends").alias("n"), F.max("at").alias("last"), ends.alias("end"), gap.alias("gap"))
    # a page that comes after a pause and ends the cycle makes all up to date again
    stale = F.when(F.col("gap").isNotNull() & (F.col("end").isNull() | (F.col("gap") > F.col("end"))), True).otherwise(F.when(F.col("end").isNotNull(), False).otherwise(F.col("refilling")))
    after = after.select((F.col("cycle") + F.col("n")).alias("cycle"), (F.col("done") + F.col("n")).alias("done"), stale.alias("refilling"), F.coalesce("last", "_at").alias("at"))
    none = progress.join(told.select(F.lit(1)).limit(1), F.lit(True), "left_anti")
    after = after.unionByName(none)
    new = told.select(F.posexplode("offers").alias("pos", "x"), F.col("own").alias("cycle"), "seq").where("x.id is not null").select("x.*", "cycle", "seq", "pos")
    both = offers.unionByName(new.select(*offers.columns))
    last = both.groupBy("id").agg(F.max_by(F.struct(*[c for c in offers.columns if c != "id"]), F.struct("seq", "pos")).alias("x")).select("id", "x.*").select(*offers.columns)
    now = after.select(F.col("cycle").alias("_now"))  # one row
    kept = last.crossJoin(F.broadcast(now)).where(F.col("cycle") >= F.col("_now") - 1).drop("_now")
    return kept, after


def follow_market(pages: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """(offers, progress) after all pages of the stream; started again on the same path it goes on.

    ``progress`` is the cycle, how many are done, whether the state is complete (a cycle is done, and no pause since its
    end), and the time of the last page. Offers without an id are left out; a null page or number of pages ends a cycle.
    """
    spark = pages.sparkSession

    def state(own: SparkSession, number: int) -> tuple[DataFrame, DataFrame]:
        if number < 0:
            return own.createDataFrame([], OFFER), own.createDataFrame([(1, 0, False, None)], PROGRESS)
        return own.read.schema(OFFER).parquet(f"{path}/offers-{number % 2}"), own.read.schema(PROGRESS).parquet(f"{path}/progress-{number % 2}")

    def step(batch: DataFrame, number: int) -> None:
        offers, progress = turn(batch, *state(batch.sparkSession, number - 1))
        offers.write.mode("overwrite").parquet(f"{path}/offers-{number % 2}")
        progress.withColumn("_number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/progress-{number % 2}")

    query = pages.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = [(r["_number"], r) for k in (0, 1) for r in _rows(spark, f"{path}/progress-{k}")]
    if not found:
        offers, progress = state(spark, -1)
        return offers, {"cycle": 1, "done": 0, "complete": False, "at": None}
    number, row = max(found, key=lambda x: x[0])
    return state(spark, number)[0], {"cycle": row["cycle"], "done": row["done"], "complete": row["done"] > 0 and not row["refilling"], "at": row["at"]}


def _rows(spark: SparkSession, path: str) -> list:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return []
    return spark.read.parquet(path).collect()  # one row


def market_items(offers: DataFrame) -> DataFrame:
    """Offers by name and kind: least positive price, quantity, number of sellers, sales of a week. Null kind is ''."""
    week = F.bround(F.col("sold_30d") * 7 / 30, 0).cast("long")
    return offers.groupBy("name", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.min(F.when(F.col("price") > 0, F.col("price"))).alias("price"), F.sum("quantity").alias("stock"), F.count_distinct("seller").alias("sellers"), F.sum(week).alias("sales_week"))
