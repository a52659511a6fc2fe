"""Snapshot files: text of any usual encoding, JSON rows with their corrupt ones set apart, settings with defaults, and writers that replace a part.

All paths are URIs of a folder that driver and executors share. Writers rely on the commit of a whole write: readers see
the version that a pointer names, or partitions that are replaced as one.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of markets with the interval in seconds and the fee that count where a setting is wrong.
KINDS = {"sweep": (300, 0.0), "cards": (120, 0.0), "offers": (120, 0.0), "shop": (120, 0.0)}
LEAST_INTERVAL = 30


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of files: by their byte order mark, else UTF-8 where that is valid, else Windows-1251.

    A file is one row, as every file of this kind is small; the bytes that say nothing in Windows-1251 become U+FFFD.
    """

    @F.pandas_udf("string")
    def old(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else b.decode("cp1251", "replace"))

    content = F.col("content")
    head = F.hex(F.substring(content, 1, 3))
    text = (
        F.when(head.startswith("FFFE"), F.decode(content, "UTF-16"))
        .when(head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))
        .otherwise(old(content))
    )
    return spark.read.format("binaryFile").load(path).select("path", text.alias("text"))


def read_rows(spark: SparkSession, path: str, schema: str, wanted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): JSON lines by a schema, and the lines that are none as text. Errors of reading are raised, never quarantined.

    A field of another type is null. ``wanted`` keeps rows, as those of known categories.
    """
    read = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    text = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    bad = text.where(F.try_parse_json("value").isNull()).select("value")
    rows = read.where(F.col("_corrupt").isNull() | F.try_parse_json("_corrupt").isNotNull()).drop("_corrupt")
    return (rows if wanted is None else rows.where(wanted)), bad


def quarantine(bad: DataFrame, folder: str) -> None:
    """Add corrupt lines to a folder, with the time at which they were set apart."""
    bad.withColumn("at", F.current_timestamp()).write.mode("append").parquet(folder)


def checked_markets(raw: DataFrame) -> DataFrame:
    """name, kind, url, interval and fee of market settings: rows of an unknown kind or without an http address go; an
    interval below LEAST_INTERVAL or a fee outside [0, 1), or of another type, is the kind's default. Rows with a null name keep it."""
    known = raw.sparkSession.createDataFrame([(k, i, f) for k, (i, f) in KINDS.items()], "kind string, _i int, _f double")  # a fixed few
    rows = raw.join(F.broadcast(known), "kind").where(F.coalesce(F.col("url"), F.lit("")).rlike("^https?://[^/ ]+"))
    interval, fee = F.expr("try_cast(interval AS int)"), F.expr("try_cast(fee AS double)")
    return rows.select("name", "kind", "url", F.when(interval >= LEAST_INTERVAL, interval).otherwise(F.col("_i")).alias("interval"), F.when((fee >= 0) & (fee < 1), fee).otherwise(F.col("_f")).alias("fee"))


def publish(rows: DataFrame, folder: str) -> str:
    """Write a snapshot as a new version and then name it in the pointer; readers see the old one or the new one, whole."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/v-{version}")
    pointer = rows.sparkSession.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    pointer.write.mode("append").parquet(f"{folder}/pointer")
    return version


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that the pointer names last."""
    row = spark.read.parquet(f"{folder}/pointer").agg(F.max_by("version", "at").alias("v")).first()
    return spark.read.parquet(f"{folder}/v-{row['v']}")


def replace_categories(rows: DataFrame, folder: str, category: str = "category") -> None:
    """Replace the categories that occur in ``rows``; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(category).parquet(folder)


def merge_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, src, url, feature, at: of each key and source the newest valid row of both, those of ``new`` first in a tie."""
    valid = F.length("feature").between(1, 4096) & F.col("feature").rlike("^[A-Za-z0-9+/=]+$")
    rows = old.withColumn("_p", F.lit(0)).unionByName(new.where(valid).withColumn("_p", F.lit(1)))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("key", "src").orderBy(F.desc("at"), F.desc("_p"), "url", "feature"))).where("_k = 1").drop("_k", "_p")


def append_rate(spark: SparkSession, folder: str, rate: float | None, at: str) -> None:
    """Keep a rate that was read; a failed reading (null, or not above 0) changes nothing."""
    if rate is not None and rate > 0:
        spark.createDataFrame([(float(rate), at)], "rate double, at string").select("rate", F.col("at").cast("timestamp")).write.mode("append").parquet(folder)


def current_rate(spark: SparkSession, folder: str) -> float | None:
    return spark.read.parquet(folder).agg(F.max_by("rate", "at")).first()[0]
