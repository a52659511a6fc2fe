"""Windows over keys of any size: a key's rows are cut into buckets of their order, and only what one bucket hands to the next crosses.

A plain window sorts all rows of a key in one task. Here a task sorts those of one key and bucket, beside a row that
brings what came before. ``bucket`` is a column that never decreases along the order (a day of a time, say). Keys, order
and bucket may be null: null keys are one key, and null comes first. Empty tables give empty results, and other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks the rows that carry over; no column of the caller's may have this name.
CARRIED = "_carried"


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.withColumn(CARRIED, F.lit(False)).unionByName(carried.withColumn(CARRIED, F.lit(True)), allowMissingColumns=True)


def lagged(rows: DataFrame, keys: list[str], order: list[str], values: list[str], bucket: str) -> DataFrame:
    """rows with ``before_<value>`` of each value: that of the row before of the same key, null on the first; ``order`` holds no ties."""
    beside = [v for v in values if v not in order]
    last = rows.groupBy(*keys, bucket).agg(F.max(F.struct(*order, *beside)).alias("x"))
    ahead = Window.partitionBy(*keys).orderBy(bucket)  # a row for each bucket
    to = last.withColumn("to", F.lead(bucket).over(ahead)).where(F.col("to").isNotNull())
    carried = to.select(*keys, F.col("to").alias(bucket), *[F.col("x")[c].alias(c) for c in [*order, *beside]])
    w = Window.partitionBy(*keys, bucket).orderBy(F.desc(CARRIED), *order)
    return _with_carried(rows, carried).withColumns({f"before_{v}": F.lag(v).over(w) for v in values}).where(~F.col(CARRIED)).drop(CARRIED)


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, bucket: str, into: str, descending: bool = False) -> DataFrame:
    """rows with ``into``: the sum of a whole number, ``value``, over the rows of the same key up to and with this one; ``order`` holds no ties."""
    turn = F.desc if descending else F.asc
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias(value))
    before = Window.partitionBy(*keys).orderBy(turn(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("before", F.sum(value).over(before)).where("before IS NOT NULL").select(*keys, bucket, F.col("before").alias(value))
    w = Window.partitionBy(*keys, bucket).orderBy(F.desc(CARRIED), *[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return _with_carried(rows, carried).withColumn(into, F.sum(value).over(w)).where(~F.col(CARRIED)).drop(CARRIED)


def trailing(rows: DataFrame, keys: list[str], at: str, width: int, values: dict[str, Column]) -> DataFrame:
    """rows with the sums ``values`` (new name to column) over the rows of the same key whose whole number ``at`` is at most ``width`` smaller, ties included.

    A row is in the bucket of its own and in the next one, so that each sum lies within a bucket; rows where ``at`` is
    null are one bucket of their key and share their sum.
    """
    both = rows.withColumn("_step", F.explode(F.when(F.col(at).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    both = both.withColumn("_bucket", F.floor(F.col(at) / F.lit(width)) + F.col("_step"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(at).rangeBetween(-width, 0)
    return both.withColumns({name: F.sum(v).over(w) for name, v in values.items()}).where("_step = 0").drop("_step", "_bucket")


def upper_median(rows: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """keys and, of each, the value at place n / 2 + 1 (rounded down) of its n values in order; null values don't count.

    Values are counted by bands of their size; only those of the band that holds the place are ranked, and equal ones
    are counted before they meet.
    """
    banded = rows.where(F.col(value).isNotNull()).select(*keys, value, F.floor(F.signum(value) * F.log2(1 + F.abs(value)) * 64).alias("_band"))
    key = Window.partitionBy(*keys)  # a row for each band
    upto = F.sum("held").over(key.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0))
    bands = banded.groupBy(*keys, "_band").agg(F.count("*").alias("held")).withColumns({"upto": upto, "place": F.floor(F.sum("held").over(key) / 2) + 1})
    bands = bands.where("place <= upto AND place > upto - held").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_band").alias("_in"), (F.col("place") - F.col("upto") + F.col("held")).alias("place"))
    own = F.lit(True)
    for k in keys:
        own &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    # a half join, as it is the bands that may be broadcast and never the rows
    counts = banded.join(bands, own & (F.col("_band") == F.col("_in")), "left_semi").groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(key.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.join(bands, own).where("upto >= place").groupBy(*keys).agg(F.min(value).alias(into))
