"""Stream forms of ranks and of totals that are shown again as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt_hour
from ..operators.windows import totals


def top_per_key(df: DataFrame, size: str, second: str, n: int) -> DataFrame:
    """The ``n`` best windows of each (productID, traffic) in a second, longer window, by chained windows.

    A group holds at most second / size rows. Rows equal in orders and fee collapse to
    the first. For ``append`` mode; ``df`` has ``event_time`` with its watermark.
    """
    keys = ["productID", "traffic"]
    first = df.groupBy(F.window("event_time", size).alias("w"), *keys).agg(*totals())
    row = F.struct("orders", "totalFee", (-F.unix_millis("w.start")).alias("before"), F.unix_millis("w.end").alias("end"))
    both = first.groupBy(F.window(F.window_time("w"), second).alias("w2"), *keys).agg(F.collect_set(row).alias("rows"))
    best = both.select("w2", *keys, F.sort_array("rows", False).alias("rows"))
    new = lambda x, i: (i == 0) | (F.get("rows", i - 1)["orders"] != x["orders"]) | (F.get("rows", i - 1)["totalFee"] != x["totalFee"])
    top = best.select(F.unix_millis("w2.start").alias("window2"), *keys, F.posexplode(F.slice(F.filter("rows", new), 1, n)).alias("rank", "r"))
    return top.select(
        "window2", *keys, (-F.col("r.before")).alias("startWindowTime"), F.col("r.end").alias("endWindowTime"),
        "r.orders", "r.totalFee", (F.col("rank") + 1).cast("long").alias("rank"),
    )


def stat_time(df: DataFrame, exact: bool = True) -> DataFrame:
    """Totals so far of (traffic, hour) in its day (midnight in UTC+8).

    For ``update`` mode with a processing-time trigger, which shows them at each
    interval. The exact user set of a day is state; HyperLogLog is the option.
    """
    users = F.size(F.collect_set("userID")).cast("long") if exact else F.approx_count_distinct("userID")
    day = F.window("event_time", "1 day", "1 day", "16 hours").alias("w")
    out = df.groupBy(day, "traffic", fmt_hour("ct").alias("etTime")).agg(F.count("*").alias("orders"), users.alias("users"), F.sum(F.col("fee").cast("long")).alias("totalFee"))
    return out.select("traffic", "etTime", F.unix_millis("w.start").alias("startWindowTime"), "orders", "users", "totalFee")
