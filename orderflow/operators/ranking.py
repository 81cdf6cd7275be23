"""Best rows of a second, longer window over the product totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _second(df: DataFrame, size_ms: int) -> DataFrame:
    return df.withColumn("window2", F.col("startWindowTime") - F.pmod("startWindowTime", F.lit(size_ms)))


def top_per_key(product_totals: DataFrame, size_ms: int, n: int) -> DataFrame:
    """The ``n`` best windows of each (productID, traffic) by orders, then fee; rows equal in both collapse to the first."""
    keys = ["window2", "productID", "traffic"]
    one = _second(product_totals, size_ms).groupBy(*keys, "orders", "totalFee").agg(F.min(F.struct("startWindowTime", "endWindowTime")).alias("w"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("orders"), F.desc("totalFee"))).cast("long")
    return one.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "w.*", "orders", "totalFee", "rank")


def top_per_window(product_totals: DataFrame, size_ms: int, n: int) -> DataFrame:
    """The ``n`` best rows of each window over all products; Spark keeps n rows of each task before it shuffles."""
    order = [F.desc("orders"), F.desc("totalFee"), "productID", "traffic", "startWindowTime"]
    rank = F.row_number().over(W.partitionBy("window2").orderBy(*order)).cast("long")
    out = _second(product_totals, size_ms).withColumn("rank", rank).where(F.col("rank") <= n)
    return out.select("window2", "productID", "traffic", "startWindowTime", "endWindowTime", "orders", "totalFee", "rank")
