"""Readers and the scratch folder that the queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reread(df: DataFrame, path: str) -> DataFrame:
    """Rows written to ``path``, to read again. They join by shuffles: what a few megabytes of compressed files hold can be
    gigabytes of rows, and Spark, which goes by the files, would have the driver collect and broadcast them."""
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lotwise-")
    return f"{base.rstrip('/')}/lotwise-{name}-{uuid.uuid4().hex}"
