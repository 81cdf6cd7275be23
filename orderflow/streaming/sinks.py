"""Sinks: keyed messages, upserts, running totals, key-value frames and hourly Parquet.

A sink that can be written twice by a restarted query gives the same table: upserts keep
the latest row of each id, and totals are written as totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import fmt_hour, json_out, key_concat, key_md5, key_partition

#: The fields of each topic's message key.
TOPIC_KEYS = {
    "order_detail": ("productID", "traffic"),
    "order_wide": ("orderID", "productID", "ct"),
    "order_mwide": ("orderID", "productID", "pubID", "ct"),
    "order_wide_agg": ("productType", "toursimType"),
    "order_topn": ("productID", "traffic"),
    "page_view": ("sid", "userDevice", "targetID"),
    "view_list_fact": ("sid", "userDevice", "userID"),
    "view_list": ("sid", "userDevice", "userID"),
    "page_view_alert": ("userID", "userRegion", "userRegionIP"),
}


def messages(df: DataFrame, topic: str, partitions: int | None = None) -> DataFrame:
    """key and value of a topic, and the partition if their number is given; raw logs are keyed by their sid."""
    key = F.col("sid") if topic == "user_log" else key_md5(*TOPIC_KEYS[topic])
    out = df.select(key.alias("key"), json_out(df).alias("value"))
    return out.withColumn("partition", key_partition("key", "value", partitions).cast("int")) if partitions else out


def to_kafka(df: DataFrame, topic: str, servers: str, checkpoint: str, partitions: int | None = None) -> DataStreamWriter:
    return messages(df, topic, partitions).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each id; rows without an id go. The greatest struct is summed before the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = F.max(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), *rest)).alias("_last")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *(F.col("_last")[c].alias(c) for c in rest)).select(*df.columns)


def upserted(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``table`` with ``rows`` inserted or put in place of older ones."""
    return latest(table.unionByName(rows), key, order)


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df``'s rows as key and JSON value, with their ``startWindowTime``."""
    return df.select(key_concat(*keys).alias("key"), json_out(df).alias("value"), "startWindowTime")


def key_values(df: DataFrame, *keys: str) -> DataFrame:
    """key and JSON value of the latest window of each key."""
    return latest(keyed(df, *keys), "key", ["startWindowTime"]).select("key", "value")


class Upserts:
    """A Parquet folder with the latest rows of each micro-batch; the newest row of each id is the table's.

    A batch writes a folder of its own and nothing else, and a batch that is run again
    replaces its folder, so a restarted query leaves the table as it was. ``fold`` joins the
    folders of many batches into one.
    """

    def __init__(self, spark, path: str, key: str, order: list[str]):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        latest(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _folders(self) -> tuple[int | None, list[int]]:
        """The newest fold that is complete, and the batches after it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        complete = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        names = [s.getPath() for s in (files.listStatus(place) if files.exists(place) else []) if s.isDirectory()]
        number = lambda kind: sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith(f"{kind}=") and complete(p))
        folds = number("fold")
        fold = folds[-1] if folds else None
        return fold, [b for b in number("batch") if fold is None or b > fold]

    def _versions(self, fold: int | None, batches: list[int]) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.path}/fold={fold}").withColumn("batch", F.lit(fold))] if fold is not None else []
        if batches:
            frames.append(self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/batch={b}" for b in batches)))
        if not frames:
            raise FileNotFoundError(f"no batch has been written to {self.path}")
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def read(self) -> DataFrame:
        return latest(self._versions(*self._folders()), self.key, [*self.order, "batch"]).drop("batch")

    def fold(self, up_to: int) -> None:
        """Joins all batches up to that one, which must be committed, into one folder, and then drops theirs.

        Until the folder is complete readers use the batches, and then only the folder; a fold
        that is cut short can be run again.
        """
        fold, batches = self._folders()
        batches = [b for b in batches if b <= up_to]
        if not batches:
            return
        rows = latest(self._versions(fold, batches), self.key, [*self.order, "batch"]).drop("batch")
        rows.write.mode("overwrite").parquet(f"{self.path}/fold={up_to}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        files = place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(place(self.path)):
            kind, _, number = status.getPath().getName().partition("=")
            if (kind == "batch" and int(number) <= up_to) or (kind == "fold" and int(number) < up_to):
                files.delete(status.getPath(), True)


def to_store(df: DataFrame, put, checkpoint: str) -> DataStreamWriter:
    """Writes the latest window of each key of a micro-batch: ``put(rows, batch)`` gets a frame of key, value and startWindowTime."""

    def write(rows: DataFrame, batch: int) -> None:
        put(latest(rows, "key", ["startWindowTime"]), batch)

    return df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)


def landing(df: DataFrame, hour: str = "ct") -> DataFrame:
    """ORDER_DETAIL with ``dt_hour``, by which it is partitioned."""
    return df.withColumn("dt_hour", fmt_hour(hour))


def land(df: DataFrame, path: str, checkpoint: str | None = None):
    """Writes hourly folders: a stream writer with ``checkpoint``, else a batch write."""
    if df.isStreaming:
        return landing(df).writeStream.format("parquet").partitionBy("dt_hour").option("path", path).option("checkpointLocation", checkpoint)
    landing(df).write.mode("append").partitionBy("dt_hour").parquet(path)
