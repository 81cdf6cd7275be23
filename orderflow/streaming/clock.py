"""Operators on the processing-time clock: they flush when the clock says so, also if nothing more comes.

Timers stand at multiples of the interval. A key's timer arms itself again for as long
as the key has an open batch or window; an idle key leaves neither timer nor state. Open
batches are in the checkpoint, so a restarted query flushes them at the first boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import div
from ..operators.windows import members


def after(now_ms: int, interval_ms: int) -> int:
    """The first boundary after a time."""
    return now_ms - now_ms % interval_ms + interval_ms


def ticking(df: DataFrame) -> DataFrame:
    """``df`` with a clock beside it that brings no rows.

    A running query looks at its timers also if nothing comes, but one that was restarted
    does so only after its first batch, which an idle source would never bring about.
    """
    spark = df.sparkSession
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") < 0)
    return df.unionByName(clock.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)))


class _Aligned(StatefulProcessor):
    """Keeps one timer for a key, at the end of the interval in which its open rows came."""

    interval: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def arm(self, now_ms: int) -> None:
        if not self.due.exists():
            at = after(now_ms, self.interval)
            self.due.update((at,))
            self.handle.registerTimer(at)

    def boundary(self, expired) -> int | None:
        """The boundary of the timer, None if it is not the one that stands."""
        at = int(expired.getExpiryTimeInMs())
        if not self.due.exists() or self.due.get()[0] != at:
            return None
        self.due.clear()
        return at

    def overdue(self, now_ms: int) -> int | None:
        """The boundary that has passed while its timer still waits, which it then does no more."""
        if not self.due.exists() or (at := int(self.due.get()[0])) > now_ms:
            return None
        self.handle.deleteTimer(at)
        self.due.clear()
        return at

    def close(self) -> None:
        pass


class CountOrClock(_Aligned):
    """Totals of a key, flushed at n orders or when the clock passes the interval's end.

    Orders come into a batch as they arrive; those of one micro-batch by (ct, orderID).
    The open batch is a list to which rows are added, at most n - 1 of them.
    """

    def __init__(self, n: int, interval_ms: int):
        self.n, self.interval = n, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "ct long, userID string, fee long")
        self.size = handle.getValueState("size", "n long")

    def _flush(self, key, rows: list[tuple], end: int, by: str) -> dict:
        return {
            "productType": key[0], "toursimType": key[1], "startWindowTime": min(r[0] for r in rows), "endWindowTime": end, "orders": len(rows),
            "users": len({r[1] for r in rows if r[1] is not None}), "totalFee": sum(r[2] for r in rows if r[2] is not None), "trigger": by,
        }

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True).sort_values(["ct", "orderID"], ignore_index=True)
        new = [(int(ct), user, None if pd.isna(fee) else int(fee)) for ct, user, fee in zip(df["ct"], df["userID"], df["fee"], strict=True)]
        now, out = int(timerValues.getCurrentProcessingTimeInMs()), []
        # Input comes before timers: a batch whose boundary has passed is flushed before later orders come in.
        if (at := self.overdue(now)) is not None:
            out += self._left(key, at)
        held = int(self.size.get()[0]) if self.size.exists() else 0
        if held + len(new) >= self.n:
            every = [tuple(r) for r in self.open.get()] + new if held else new
            while len(every) >= self.n:
                full, every = every[: self.n], every[self.n :]
                out.append(self._flush(key, full, max(r[0] for r in full), "count"))
            self.open.clear()
            held, new = 0, every
        if new:
            self.open.appendList(new)
            self.arm(now)
        self.size.update((held + len(new),))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.boundary(expiredTimerInfo)
        if at is not None and (out := self._left(key, at)):
            yield pd.DataFrame(out)

    def _left(self, key, at: int) -> list[dict]:
        rows = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        self.open.clear()
        self.size.clear()
        return [self._flush(key, rows, at, "timer")] if rows else []


def stat_count_or_time(df: DataFrame, interval_ms: int, n: int) -> DataFrame:
    """Orders, users and fee of (productType, toursimType), flushed at ``n`` orders or at the clock's next multiple of the interval.

    As the event-time form, but an idle source delays no flush: a timer's row ends at the
    boundary of the clock, and starts like all others at its first order's time.
    """
    df = df.select("productType", "toursimType", "ct", "orderID", "userID", F.col("fee").cast("long").alias("fee"))
    schema = "productType string, toursimType string, startWindowTime long, endWindowTime long, orders long, users long, totalFee long, trigger string"
    return ticking(df).groupBy("productType", "toursimType").transformWithStateInPandas(CountOrClock(n, interval_ms), schema, "append", "ProcessingTime")


class ClockWindows(_Aligned):
    """M4 of what arrives in an interval of the clock; the state is four numbers."""

    def __init__(self, interval_ms: int, names: list[str]):
        self.interval, self.names = interval_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getValueState("sums", "orders long, maxFee long, totalFee long, members long")

    def _closed(self, key, at: int) -> pd.DataFrame:
        orders, most, fee, people = (int(x) for x in self.sums.get())
        self.sums.clear()
        row = dict(zip(self.names, key, strict=True)) | {"startWindowTime": at - self.interval, "endWindowTime": at - 1, "orders": orders, "maxFee": most, "totalFee": fee, "members": people}
        return pd.DataFrame([row])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        if (at := self.overdue(now)) is not None:
            yield self._closed(key, at)
        orders, most, fee, people = (int(x) for x in self.sums.get()) if self.sums.exists() else (0, 0, 0, 0)
        for df in rows:
            orders, most = orders + int(df["orders"].sum()), max(most, int(df["maxFee"].max()))
            fee, people = fee + int(df["totalFee"].sum()), people + int(df["members"].sum())
        self.sums.update((orders, most, fee, people))
        self.arm(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.boundary(expiredTimerInfo)
        if at is not None and self.sums.exists():
            yield self._closed(key, at)


def _partial(names: list[str]):
    """Sums a task's rows by key before they are shuffled to the few keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = df.groupby(names, dropna=False).agg(orders=("fee", "size"), maxFee=("fee", "max"), totalFee=("fee", "sum"), members=("members", "sum"))
            out = out.reset_index().assign(maxFee=lambda x: x["maxFee"].clip(lower=0))
            yield out.assign(**{k: out[k].astype(object).where(out[k].notna(), None) for k in names})

    return run


def clock_windows(df: DataFrame, keys: list[str], interval_ms: int) -> DataFrame:
    """M4 and the average fee of each key's orders that arrive in an interval of the clock; windows end 1 ms early."""
    fields = "orders long, maxFee long, totalFee long, members long"
    rows = df.select(*(F.col(k).cast("string").alias(k) for k in keys), F.coalesce(F.col("fee").cast("long"), F.lit(0)).alias("fee"), members().alias("members"))
    named = "".join(f"{k} string, " for k in keys)
    sums = rows.mapInPandas(_partial(keys), named + fields)
    out = ticking(sums).groupBy(*keys).transformWithStateInPandas(ClockWindows(interval_ms, keys), f"{named}startWindowTime long, endWindowTime long, {fields}", "append", "ProcessingTime")
    return out.withColumn("avgFee", div(F.col("totalFee"), F.col("orders")))
