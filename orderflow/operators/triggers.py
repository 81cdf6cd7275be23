"""Batch forms of statistics that are emitted early: by count, by time, or by whichever comes first.

Rows of a key are ordered by (ct, orderID). Every window function is partitioned by key
and window or interval, so a hot key is spread over its intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fmt_hour

ORDER = ("ct", "orderID")


def _running(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, users and totalFee so far, this row included."""
    w = W.partitionBy(*keys).orderBy(*ORDER)
    df = df.withColumn("_new", (F.row_number().over(W.partitionBy(*keys, "userID").orderBy(*ORDER)) == 1).cast("long"))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"orders": F.row_number().over(w).cast("long"), "users": F.sum("_new").over(so_far), "totalFee": F.sum(F.col("fee").cast("long")).over(so_far)})


def stat_count(df: DataFrame, size_ms: int, n: int, compat: bool = False, emit_remainder: bool = False) -> DataFrame:
    """Running orders, users and fee of (traffic, hour) in a window, at every ``n``-th order.

    ``compat`` returns totals that are added up again at each firing, as the jobs that this replaces did.
    """
    df = df.withColumns({"etTime": fmt_hour("ct"), "startWindowTime": F.col("ct") - F.pmod("ct", F.lit(size_ms))})
    keys = ["traffic", "etTime", "startWindowTime"]
    run = _running(df, keys)
    fires = F.col("orders") % n == 0
    if emit_remainder:
        last = F.count("*").over(W.partitionBy(*keys))
        run = run.withColumn("_last", last)
        fires = fires | (F.col("orders") == F.col("_last"))
    fired = run.where(fires).select(*keys, "orders", "users", "totalFee")
    if compat:
        w = W.partitionBy(*keys).orderBy("orders").rowsBetween(W.unboundedPreceding, 0)
        fired = fired.select(*keys, F.sum("orders").over(w).alias("orders"), "users", F.sum("totalFee").over(w).alias("totalFee"))
    return fired


def stat_time(df: DataFrame, interval_ms: int, day_offset_ms: int = -8 * 3_600_000) -> DataFrame:
    """Totals so far of (traffic, hour) in its day, at the end of each interval that has orders.

    Sums by interval come first, so the running windows see one row for each interval.
    """
    day = 86_400_000
    start = F.col("ct") - F.pmod(F.col("ct") - day_offset_ms, F.lit(day))
    df = df.withColumns({"etTime": fmt_hour("ct"), "startWindowTime": start, "ptTime": F.col("ct") - F.pmod("ct", F.lit(interval_ms)) + interval_ms})
    keys = ["traffic", "etTime", "startWindowTime"]
    sums = df.groupBy(*keys, "ptTime").agg(F.count("*").alias("n"), F.sum(F.col("fee").cast("long")).alias("f"))
    news = df.groupBy(*keys, "userID").agg(F.min("ptTime").alias("ptTime")).groupBy(*keys, "ptTime").agg(F.count("*").alias("u"))
    w = W.partitionBy(*keys).orderBy("ptTime").rowsBetween(W.unboundedPreceding, 0)
    joined = sums.join(news, [*keys, "ptTime"], "left")
    so_far = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    return joined.select(*keys, "ptTime", so_far("n").alias("orders"), so_far("u").alias("users"), so_far("f").alias("totalFee"))


def stat_count_or_time(df: DataFrame, interval_ms: int, n: int) -> DataFrame:
    """Orders, users and fee of (productType, toursimType), flushed at ``n`` orders or the interval's end, then reset."""
    keys = ["productType", "toursimType"]
    df = df.withColumn("_start", F.col("ct") - F.pmod("ct", F.lit(interval_ms)))
    rank = F.row_number().over(W.partitionBy(*keys, "_start").orderBy(*ORDER))
    aggs = [F.count("*").alias("orders"), F.count_distinct("userID").alias("users"), F.sum(F.col("fee").cast("long")).alias("totalFee"), F.min("ct").alias("startWindowTime"), F.max("ct").alias("_last")]
    out = df.withColumn("_batch", F.floor((rank - 1) / n)).groupBy(*keys, "_start", "_batch").agg(*aggs)
    by_count = F.col("orders") >= n
    end = F.when(by_count, F.col("_last")).otherwise(F.col("_start") + interval_ms)
    return out.select(*keys, "startWindowTime", end.alias("endWindowTime"), "orders", "users", "totalFee", F.when(by_count, F.lit("count")).otherwise(F.lit("timer")).alias("trigger"))
