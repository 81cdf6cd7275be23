"""Runs of abnormal page views.

An event is part of a match if it stands in at least ``times`` consecutive abnormal
events, less than ``within`` from first to last. Any longer match holds a match of just
``times`` events around each of its events, so those are enough for alerts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import PAGE_VIEW_ALERT
from .logs import abnormal


def _islands(df: DataFrame, keys: list[str], low: int, high: int, within_ms: int, tie: str) -> tuple[DataFrame, list[str]]:
    """Abnormal rows with their island and place in (keys, time block).

    Each row also stands in the block before its own, as what may end a match that
    starts there; so neither a busy key nor a run without keys is one task. Equal rows are
    numbered, alike in both blocks, by their distance from the first of them.
    """
    own = F.floor(F.col("ct") / within_ms)
    df = df.withColumns({"_bad": abnormal(low, high), "_own": own, "_block": F.explode(F.array(own, own - 1))})
    keys = [*keys, "_block"]
    w = W.partitionBy(*keys).orderBy("ct", tie, *(c for c in PAGE_VIEW_ALERT.names if c not in ("ct", tie)))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(w).cast("long")
    df = df.withColumns({"_island": F.sum((~F.col("_bad")).cast("long")).over(so_far), "_pos": place, "_repeat": place - F.rank().over(w)})
    return df.where("_bad"), [*keys, "_island"]


def alerts(df: DataFrame, times: int = 2, within_ms: int = 180_000, low: int = 5, high: int = 50, keys: list[str] = ("userID",), tie: str = "sid") -> DataFrame:
    """PAGE_VIEW_ALERT and ``tie`` of each event in a match, once."""
    bad, island = _islands(df, list(keys), low, high, within_ms, tie)
    w = W.partitionBy(*island).orderBy("_pos")
    starts = (F.lead("ct", times - 1).over(w) - F.col("ct") < within_ms) & (F.col("_own") == F.col("_block"))
    bad = bad.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("int"))
    hit = F.max("_starts").over(w.rowsBetween(-(times - 1), 0)) == 1
    found = bad.withColumn("_hit", hit).where("_hit")
    return found.select(*PAGE_VIEW_ALERT.names, *([tie] if tie not in PAGE_VIEW_ALERT.names else []), "_repeat").distinct().drop("_repeat")


def matches(df: DataFrame, times: int = 2, within_ms: int = 180_000, low: int = 5, high: int = 50, keys: list[str] = ("userID",), tie: str = "sid") -> DataFrame:
    """Every match: first and last event and the number of events.

    The join is on island and on time blocks of ``within``, so only rows less than two
    blocks apart meet.
    """
    bad, island = _islands(df, list(keys), low, high, within_ms, tie)
    bad = bad.withColumn("_b", F.floor(F.col("ct") / within_ms))
    first = bad.where("_own = _block").select(*island, F.col("_pos").alias("p"), F.col("ct").alias("startCt"), F.col(tie).alias("startId"), F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    last = bad.select(*island, F.col("_pos").alias("q"), F.col("ct").alias("endCt"), F.col(tie).alias("endId"), "_b")
    pairs = first.join(last, [*island, "_b"]).where((F.col("q") - F.col("p") >= times - 1) & (F.col("endCt") - F.col("startCt") < within_ms))
    keep = [k for k in keys]
    return pairs.select(*keep, "startId", "endId", "startCt", "endCt", (F.col("q") - F.col("p") + 1).alias("events"))
