"""Sources: topics, dimension tables over JDBC, replayed files, and a dimension that is read again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_options(servers: str, topic: str, starting: str = "earliest", per_batch: int | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}
    return options | ({"maxOffsetsPerTrigger": str(per_batch)} if per_batch else {})


def topic(spark: SparkSession, servers: str, name: str, starting: str = "earliest", per_batch: int | None = None) -> DataFrame:
    """A stream with the raw message in ``value``. Orders start at the earliest offset; logs may start at the latest."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, name, starting, per_batch))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None, **options: str) -> DataFrame:
    """The rows of a SELECT."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).options(**options)
    return (reader.option("driver", driver) if driver else reader).load()


def json_lines(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Replayed messages, one a line, in ``value``."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def parquet(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class Refreshed:
    """A dimension that is read again once ``ttl`` seconds have passed; for use in ``foreachBatch``."""

    def __init__(self, read: Callable[[], DataFrame], ttl: float = 60, clock: Callable[[], float] = time.monotonic):
        self.read, self.ttl, self.clock = read, ttl, clock
        self.at, self.df = None, None

    def get(self) -> DataFrame:
        now = self.clock()
        if self.df is None or now - self.at >= self.ttl:
            old, self.df, self.at = self.df, self.read().cache(), now
            if old is not None:
                old.unpersist()
        return self.df
