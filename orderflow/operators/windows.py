"""Aggregates over time and count windows.

All group-bys sum map-side before the shuffle, so hot regions or traffic kinds need no
salting. Window bounds are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import div, event_time

DELAY, LATENESS = "5 seconds", "10 seconds"
#: Delay and allowed lateness together.
WATERMARK = "15 seconds"
MAX_LONG = 2**63 - 1


def with_event_time(df: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """Adds ``event_time``; on streams also the watermark."""
    df = df.withColumn("event_time", event_time("ct"))
    return df.withWatermark("event_time", watermark) if watermark and df.isStreaming else df


def milliseconds(size: str) -> int:
    """A length such as ``10 seconds`` in milliseconds."""
    number, unit = size.split()
    return int(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def members() -> Column:
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))
    return number("adult") + number("yonger") + number("baby")


def m4() -> list[Column]:
    """orders, maxFee (never below 0), totalFee, members."""
    fee = F.col("fee").cast("long")
    return [F.count("*").alias("orders"), F.greatest(F.max(fee), F.lit(0)).alias("maxFee"), F.sum(fee).alias("totalFee"), F.sum(members()).alias("members")]


def totals() -> list[Column]:
    return [F.count("*").alias("orders"), F.sum(F.col("fee").cast("long")).alias("totalFee")]


def _windowed(df: DataFrame, keys: list[str], window: Column, aggs: list[Column], last_ms: bool, avg: bool) -> DataFrame:
    out = df.groupBy(window.alias("w"), *keys).agg(*aggs)
    end = F.unix_millis("w.end") - (1 if last_ms else 0)
    names = [c for c in out.columns if c not in ("w", *keys)]
    average = [div(F.col("totalFee"), F.col("orders")).alias("avgFee")] if avg else []
    return out.select(*keys, F.unix_millis("w.start").alias("startWindowTime"), end.alias("endWindowTime"), *names, *average)


def region_traffic(df: DataFrame, size: str = "10 seconds", slide: str | None = None) -> DataFrame:
    return _windowed(df, ["userRegion", "traffic"], F.window("event_time", size, slide), m4(), False, True)


def product_traffic(df: DataFrame, size: str = "10 seconds", slide: str | None = None) -> DataFrame:
    return _windowed(df, ["productID", "traffic"], F.window("event_time", size, slide), totals(), False, False)


def wide_type(df: DataFrame, size: str = "10 seconds", time: str = "event_time") -> DataFrame:
    """``time`` is the event time, or a column stamped at ingest for processing time."""
    return _windowed(df, ["productType", "toursimType"], F.window(time, size), m4(), True, True)


def session_traffic(df: DataFrame, gap: str, block_ms: int = 86_400_000) -> DataFrame:
    """Sessions of each traffic kind: orders at most ``gap`` apart.

    In a batch, sessions are first built inside time blocks, so the few traffic kinds
    are spread over many tasks; then sessions that touch are joined, a row for each.
    """
    if df.isStreaming:
        return _windowed(df, ["traffic"], F.session_window("event_time", gap), m4(), True, True)
    part = df.groupBy(F.floor(F.unix_millis("event_time") / block_ms).alias("_block"), "traffic", F.session_window("event_time", gap).alias("w")).agg(*m4())
    part = part.select("traffic", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "orders", "maxFee", "totalFee", "members")
    by_time = W.partitionBy("traffic").orderBy("s", "e")
    apart = F.coalesce(F.col("s") > F.max("e").over(by_time.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    joined = part.withColumn("_new", apart.cast("long")).withColumn("_session", F.sum("_new").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    sums = [F.sum("orders").alias("orders"), F.max("maxFee").alias("maxFee"), F.sum("totalFee").alias("totalFee"), F.sum("members").alias("members")]
    out = joined.groupBy("traffic", "_session").agg(F.min("s").alias("s"), F.max("e").alias("e"), *sums)
    fields = ["orders", "maxFee", "totalFee", "members"]
    return out.select("traffic", F.unix_millis("s").alias("startWindowTime"), (F.unix_millis("e") - 1).alias("endWindowTime"), *fields, div(F.col("totalFee"), F.col("orders")).alias("avgFee"))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, block_ms: int = 3_600_000) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its key, whose time comes first in ``order``.

    Rows are numbered inside (key, time block); the blocks' counts, summed over the
    blocks before, give each block its first place. So a key with most of the rows is
    numbered in as many tasks as it has blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.unix_millis("event_time") / block_ms))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    counts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    local = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order)).cast("long") - 1
    out = blocked.withColumn(name, local).join(counts, [*same, F.col("_block") == F.col("_kb")])
    return out.withColumn(name, F.col(name) + F.col("_first")).select(*df.columns, name)


def count_windows(df: DataFrame, keys: list[str], n: int, block_ms: int = 3_600_000) -> DataFrame:
    """M4 of every ``n`` orders of a key, in the order of (ct, orderID); a last short batch is not returned."""
    batches = ranked(df, keys, ["ct", "orderID"], "_place", block_ms).withColumn("batch", F.floor(F.col("_place") / n)).groupBy(*keys, "batch").agg(*m4()).where(F.col("orders") == n)
    fields = ["orders", "maxFee", "totalFee", "members"]
    return batches.select(*keys, "batch", F.lit(0).cast("long").alias("startWindowTime"), F.lit(MAX_LONG).alias("endWindowTime"), *fields, div(F.col("totalFee"), F.col("orders")).alias("avgFee"))


def departures(df: DataFrame) -> DataFrame:
    """Running totals by departure: orders, fee and the latest time."""
    return df.groupBy("depCode").agg(F.count("*").alias("orders"), F.sum(F.col("fee").cast("long")).alias("fee"), F.max("ct").alias("ct"))


def accumulated(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored totals of departures with those of new orders added."""
    both = stored.select("depCode", "orders", "fee", "ct").unionByName(new.select("depCode", "orders", "fee", "ct"))
    return both.groupBy("depCode").agg(F.sum("orders").alias("orders"), F.sum("fee").alias("fee"), F.max("ct").alias("ct"))


def distinct_users(df: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Exact by default; on streams the exact set is kept in state, or HyperLogLog if not exact."""
    if not exact:
        users = F.approx_count_distinct("userID")
    elif df.isStreaming:
        users = F.size(F.collect_set("userID")).cast("long")
    else:
        users = F.count_distinct("userID")
    return df.groupBy(*keys).agg(users.alias("users"))


# Declared as result records only, computed nowhere in the jobs; plain group-bys.


def launch_stats(logs: DataFrame, size: str) -> DataFrame:
    return _windowed(logs, ["userRegion"], F.window("event_time", size), [F.count("*").alias("access"), F.count_distinct("userID").alias("users")], False, False)


def page_view_stats(views: DataFrame, size: str) -> DataFrame:
    d = F.expr("try_cast(duration as bigint)")
    aggs = [F.count("*").alias("access"), F.count_distinct("userID").alias("users"), F.sum(d).alias("totalDuration"), div(F.sum(d), F.count("*")).alias("avgDuration"), F.max("ct").alias("maxTimestamp")]
    return _windowed(views, ["targetID"], F.window("event_time", size), aggs, False, False)


def low_durations(views: DataFrame, threshold: int = 5) -> DataFrame:
    return views.where(F.expr("try_cast(duration as bigint)") < threshold)


def click_stats(clicks: DataFrame, size: str | None) -> DataFrame:
    """By region and target type for each window, or by target type alone."""
    if size is None:
        return clicks.groupBy("eventTargetType").agg(F.count("*").alias("clicks"))
    return _windowed(clicks, ["userRegion", "eventTargetType"], F.window("event_time", size), [F.count("*").alias("clicks")], False, False)


def traffic_stats(orders: DataFrame, size: str) -> DataFrame:
    aggs = [F.count("*").alias("orders"), F.count_distinct("userID").alias("users"), F.sum(F.col("fee").cast("long")).alias("totalFee")]
    return _windowed(orders, ["traffic"], F.window("event_time", size), aggs, False, False)
