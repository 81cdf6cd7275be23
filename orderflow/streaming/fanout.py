"""Several sinks from one pass over a stream, and the rows that come too late for a window.

A micro-batch is evaluated once and kept while its sinks write. Each sink that is done leaves
a mark for the batch, so a batch that is run again after a failure writes only what is
missing; a sink that failed half-way is run again, so it must be one that a batch can be
written to twice (``Upserts``, a folder for each batch).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import div
from ..functions.parse import REASON
from ..operators import windows


@dataclass(frozen=True)
class Sink:
    """``put(rows, batch)`` gets what ``rows`` makes of a micro-batch."""

    name: str
    rows: Callable[[DataFrame], DataFrame]
    put: Callable[[DataFrame, int], None]


class Marks:
    """Empty files that tell which sink has written which batch, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, batch: int, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self, batch: int, name: str) -> bool:
        place, files = self._place(batch, name)
        return files.exists(place)

    def set(self, batch: int, name: str) -> None:
        place, files = self._place(batch, name)
        files.create(place, True).close()

    def forget(self, batch: int) -> None:
        place, files = self._place(batch, "")
        files.delete(place, True)


def fan_out(df: DataFrame, sinks: list[Sink], checkpoint: str) -> DataStreamWriter:
    """A writer that gives each micro-batch of ``df`` to all sinks; their marks lie beside the checkpoint."""
    if len({s.name for s in sinks}) < len(sinks):
        raise ValueError("sinks need different names")
    marks = Marks(df.sparkSession, f"{checkpoint.rstrip('/')}/marks")

    def write(rows: DataFrame, batch: int) -> None:
        left = [s for s in sinks if not marks.done(batch, s.name)]
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if len(left) > 1 else rows
        try:
            for s in left:
                s.put(s.rows(rows), batch)
                marks.set(batch, s.name)
        finally:
            if len(left) > 1:
                rows.unpersist()
        # The batch before can't come again.
        marks.forget(batch - 1)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


LATE = "late"


def split_late(rows: DataFrame, size_ms: int, watermark: int | None) -> DataFrame:
    """``rows`` (a batch) with ``reject_reason`` ``late`` where the watermark had passed the end of a row's window, else null.

    The rule is that of a windowed aggregate: a window that ends at or before the watermark is closed.
    """
    end = F.col("ct") - F.pmod("ct", F.lit(size_ms)) + size_ms
    late = F.lit(False) if watermark is None else end <= F.lit(watermark)
    return rows.withColumn(REASON, F.when(late, F.lit(LATE)))


class LateRows:
    """Keeps track of the watermark itself, so that rows after the lateness are kept and not lost.

    The watermark of a batch is the greatest time of all batches before it, less the delay; it
    is written for each batch, so a batch that is run again is split as it was. Rows with a
    time that has not passed go to ``counted``, the others to ``late``, with a reason.
    """

    def __init__(self, spark: SparkSession, path: str, size_ms: int, delay_ms: int):
        self.spark, self.path, self.size, self.delay = spark, path.rstrip("/"), size_ms, delay_ms

    def _file(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def _read(self, batch: int) -> int | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._file(batch))
        if batch < 0 or not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema("watermark long").json(self._file(batch)).first()[0]

    def split(self, rows: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """Counted and late rows of a micro-batch of rows with ``ct``."""
        before = self._read(batch - 1)
        latest = rows.agg(F.max("ct")).first()[0]
        now = max((x for x in (before, latest - self.delay if latest is not None else None) if x is not None), default=None)
        self.spark.createDataFrame([(now,)], "watermark long").coalesce(1).write.mode("overwrite").json(self._file(batch))
        marked = split_late(rows, self.size, before)
        return marked.where(F.col(REASON).isNull()).drop(REASON), marked.where(F.col(REASON).isNotNull())


class RegionWindows:
    """Totals of region and traffic windows, beside the rows that came too late for them: all that came in is in one of the two.

    ``writer`` runs the stream. Each batch leaves its part of its windows' sums and its late
    rows in folders of its own; a window is the sum of its parts.
    """

    def __init__(self, spark: SparkSession, path: str, size: str = "10 seconds", delay_ms: int = 5_000, lateness_ms: int = 10_000):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size
        self.rows = LateRows(spark, f"{self.path}/watermarks", windows.milliseconds(size), delay_ms + lateness_ms)

    def _put(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted, late = self.rows.split(rows, batch)
            parts = windows.region_traffic(windows.with_event_time(counted), self.size).drop("avgFee")
            parts.write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")
            late.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch}")
        finally:
            rows.unpersist()

    def writer(self, orders: DataFrame, checkpoint: str) -> DataStreamWriter:
        """``orders`` are a stream's parsed orders, without a watermark."""
        return orders.writeStream.foreachBatch(self._put).option("checkpointLocation", checkpoint)

    def windows(self) -> DataFrame:
        """As ``windows.region_traffic`` of the counted rows."""
        keys = ["userRegion", "traffic", "startWindowTime", "endWindowTime"]
        sums = [F.sum("orders").alias("orders"), F.max("maxFee").alias("maxFee"), F.sum("totalFee").alias("totalFee"), F.sum("members").alias("members")]
        return self.spark.read.parquet(f"{self.path}/parts").groupBy(*keys).agg(*sums).withColumn("avgFee", div(F.col("totalFee"), F.col("orders")))

    def late(self) -> DataFrame:
        """The late rows with their reason and the batch that brought them."""
        return self.spark.read.parquet(f"{self.path}/late")
