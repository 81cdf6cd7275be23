"""Landed hours that are closed once the watermark has passed them.

The landing writes small files into the hour's folder as batches come. When the watermark of
a batch passes an hour's end, and a grace time, the hour is closed: its files are folded
once into a wanted number of files, and a mark is written. Rows that come for a closed hour
go to a folder for late rows with the hour they missed, so no closed hour is opened again.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

HOUR = 3_600_000


class ClosingHours:
    """``path`` holds open/dt_hour=…/batch=…, closed/dt_hour=…, late/batch=… and a watermark for each batch."""

    def __init__(self, spark: SparkSession, path: str, files: int = 1, delay_ms: int = 15_000):
        self.spark, self.path, self.files, self.delay = spark, path.rstrip("/"), files, delay_ms

    def _list(self, folder: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def _exists(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _delete(self, name: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _watermark(self, batch: int) -> int | None:
        if not self._exists(f"watermarks/batch={batch}/_SUCCESS"):
            return None
        return self.spark.read.schema("watermark long").json(f"{self.path}/watermarks/batch={batch}").first()[0]

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``. What is late is told by the watermark before the batch, which is read again if the batch is."""
        before = self._watermark(batch - 1)
        start = F.col("ct") - F.pmod("ct", F.lit(HOUR))
        late = F.lit(False) if before is None else start + HOUR <= F.lit(before)
        rows = rows.withColumns({"_late": late, "_hour": (start / HOUR).cast("long")}).persist()
        try:
            latest = rows.agg(F.max("ct"), F.max("_late")).first()
            now = max((x for x in (before, latest[0] - self.delay if latest[0] is not None else None) if x is not None), default=None)
            # Each batch has its own folder in the hour, so that a batch that is run again replaces what it wrote.
            for (hour,) in sorted(rows.where("not _late").select("_hour").distinct().collect()):
                part = rows.where((F.col("_hour") == hour) & ~F.col("_late")).drop("_late", "_hour")
                part.write.mode("overwrite").parquet(f"{self.path}/open/hour={hour}/batch={batch}")
            if latest[1]:
                rows.where("_late").drop("_late").withColumnRenamed("_hour", "missed_hour").write.mode("overwrite").parquet(f"{self.path}/late/batch={batch}")
        finally:
            rows.unpersist()
        if now is not None:
            self.close_until(now)
        self.spark.createDataFrame([(now,)], "watermark long").coalesce(1).write.mode("overwrite").json(f"{self.path}/watermarks/batch={batch}")

    def close_until(self, watermark: int) -> list[int]:
        """Closes the open hours that end by then; returns them as hours since the epoch.

        An hour that is closed is one folder with its mark; its small files go after that, so
        a failure in between leaves them to the next call.
        """
        done = []
        for name in self._list("open"):
            hour = int(name.split("=")[1])
            if (hour + 1) * HOUR > watermark:
                continue
            target = f"closed/dt_hour={self.name(hour)}"
            if not self._exists(f"{target}/_SUCCESS"):
                rows = self.spark.read.parquet(f"{self.path}/open/{name}").drop("batch")
                rows.repartition(self.files).write.mode("overwrite").parquet(f"{self.path}/{target}")
                done.append(hour)
            self._delete(f"open/{name}")
        return done

    @staticmethod
    def name(hour: int) -> str:
        """``yyyyMMddHH`` in UTC."""
        return datetime.fromtimestamp(hour * 3600, UTC).strftime("%Y%m%d%H")

    def writer(self, orders: DataFrame, checkpoint: str) -> DataStreamWriter:
        return orders.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)

    def closed(self) -> DataFrame:
        """The rows of closed hours, with ``dt_hour``."""
        done = [n for n in self._list("closed") if self._exists(f"closed/{n}/_SUCCESS")]
        if not done:
            raise FileNotFoundError(f"no hour is closed in {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/closed").parquet(*(f"{self.path}/closed/{n}" for n in done))

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/late")
