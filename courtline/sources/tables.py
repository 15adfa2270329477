"""Typed access to the driver's parquet tables.

Timestamps are stored without a zone (TIMESTAMP_NTZ); they are cast to TIMESTAMP under the
UTC session zone so that ``unix_micros``, interval frames and watermarks accept them.
Nothing is read eagerly: every accessor returns a lazy scan, so Catalyst prunes columns and
pushes filters into the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    casts = [F.col(f.name).cast(T.TimestampType()).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
             else F.col(f.name) for f in df.schema.fields]
    return df.select(*casts)


class Tables:
    """Lazy attribute access: ``Tables(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """One table of the folder as a file stream (new files of the same name pattern are picked
    up as they land); declared schema taken from the files, timestamps cast as in batch."""
    configure(spark)
    schema = spark.read.parquet(table_path(sf_dir, name)).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(sf_dir)
    casts = [F.col(f.name).cast(T.TimestampType()).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
             else F.col(f.name) for f in schema.fields]
    return df.select(*casts)

