"""Running totals on streams: added to what is stored already, and with exact users in state rows of one user each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fmt_hour
from .stateful import held, longs, numbers

DAY = 86_400_000


class Accumulated(StatefulProcessor):
    """Orders, fee, latest time and further sums of a key, beginning with what the store holds for it."""

    def __init__(self, more: list[str]):
        self.more = more

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", longs("orders", "fee", "ct", *self.more))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._add(initialState)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = self._add(pd.concat(list(rows), ignore_index=True))
        yield pd.DataFrame([{"depCode": key[0]} | dict(zip(("orders", "fee", "ct", *self.more), sums, strict=True))])

    def _add(self, df: pd.DataFrame) -> tuple[int, ...]:
        known = self.totals.exists()
        orders, fee, ct, *more = held(self.totals, 3 + len(self.more))
        latest = int(df["ct"].max())
        sums = (int(df[m].sum()) + v for m, v in zip(self.more, more, strict=True))
        now = (orders + int(df["orders"].sum()), fee + int(df["fee"].sum()), max(ct, latest) if known else latest, *sums)
        self.totals.update(now)
        return now

    def close(self) -> None:
        pass


def _sums(more: list[str]):
    """Sums a task's rows by key, as there are few keys to shuffle to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = df.groupby("depCode", dropna=False).agg(orders=("fee", "size"), fee=("fee", "sum"), ct=("ct", "max"), **{m: (m, "sum") for m in more}).reset_index()
            yield out.assign(depCode=out["depCode"].astype(object).where(out["depCode"].notna(), None))

    return run


def accumulate(df: DataFrame, stored: DataFrame | None = None, more: list[str] = ()) -> DataFrame:
    """The totals of each departure after each micro-batch in which it has orders: depCode, orders, fee, ct.

    ``stored`` are totals to which a fresh checkpoint adds, a row for each key; a query that
    is started again from its checkpoint has them in its state and doesn't read them. What
    comes out are totals, so a batch that is run again writes what it wrote before. ``more``
    are further columns to sum; a job may get them later, and then they count from there.
    """
    more = list(more)
    fields = "depCode string, " + longs("orders", "fee", "ct", *more)
    rows = df.select("depCode", F.coalesce(F.col("fee").cast("long"), F.lit(0)).alias("fee"), "ct", *numbers(more)).mapInPandas(_sums(more), fields)
    first = stored.select("depCode", "orders", "fee", "ct", *more).groupBy("depCode") if stored is not None else None
    return rows.groupBy("depCode").transformWithStateInPandas(Accumulated(more), fields, "append", "None", first)


class IntervalSums(StatefulProcessor):
    """Orders, fee and first appearances of users in the intervals of a (traffic, hour, day), for one bucket of users.

    A user is a state row with the earliest interval in which it was seen. An interval is
    given out once, when the watermark passes its end and no order of it can come any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getMapState("users", "userID string", "first long")
        self.sums = handle.getMapState("sums", "ptTime long", "orders long, users long, fee long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        change = {int(t): [n, 0, fee] for t, n, fee in df.groupby("ptTime").agg(n=("fee", "size"), fee=("fee", "sum")).itertuples()}
        for user, first in df.dropna(subset=["userID"]).groupby("userID")["ptTime"].min().items():
            before = self.users.getValue((user,))[0] if self.users.containsKey((user,)) else None
            if before is None or first < before:
                self.users.updateValue((user,), (int(first),))
                change[int(first)][1] += 1
                if before is not None:
                    change.setdefault(int(before), [0, 0, 0])[1] -= 1
        for t, more in change.items():
            held = self.sums.getValue((t,)) if self.sums.containsKey((t,)) else (0, 0, 0)
            self.sums.updateValue((t,), tuple(int(a) + int(b) for a, b in zip(held, more, strict=True)))
            self.handle.registerTimer(t)
        self.handle.registerTimer(int(key[2]) + 2 * DAY)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = int(expiredTimerInfo.getExpiryTimeInMs())
        if t >= int(key[2]) + 2 * DAY:  # the day and its last interval are over
            self.users.clear()
        if self.sums.containsKey((t,)):
            orders, users, fee = self.sums.getValue((t,))
            self.sums.removeKey((t,))
            at = pd.to_datetime([t], unit="ms", utc=True)
            yield pd.DataFrame({"event_time": at, "traffic": key[0], "etTime": key[1], "startWindowTime": key[2], "ptTime": t, "orders": int(orders), "users": int(users), "totalFee": int(fee)})

    def close(self) -> None:
        pass


class SoFar(StatefulProcessor):
    """Adds up the buckets' intervals, which all come with the same watermark; three numbers are its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "orders long, users long, fee long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = pd.concat(list(rows), ignore_index=True).groupby("ptTime")[["orders", "users", "totalFee"]].sum().sort_index().cumsum()
        held = [int(x) for x in self.totals.get()] if self.totals.exists() else [0, 0, 0]
        out = (sums + held).reset_index().assign(traffic=key[0], etTime=key[1], startWindowTime=key[2])
        self.totals.update(tuple(int(x) for x in out.iloc[-1][["orders", "users", "totalFee"]]))
        self.handle.registerTimer(int(key[2]) + 2 * DAY)
        yield out[["traffic", "etTime", "startWindowTime", "ptTime", "orders", "users", "totalFee"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        yield from ()

    def close(self) -> None:
        pass


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("userID"), F.lit(buckets)).cast("int").alias("bucket")


def stat_time(df: DataFrame, interval_ms: int, day_offset_ms: int = -8 * 3_600_000, buckets: int = 16) -> DataFrame:
    """Totals so far of (traffic, hour) in its day, with ``ptTime``, the end of each interval that has orders: as in a batch.

    ``df`` has ``event_time`` with its watermark. Users of a busy hour are spread over ``buckets``.
    """
    start = F.col("ct") - F.pmod(F.col("ct") - day_offset_ms, F.lit(DAY))
    pt = F.col("ct") - F.pmod("ct", F.lit(interval_ms)) + interval_ms
    keys = ["traffic", "etTime", "startWindowTime"]
    rows = df.select("traffic", fmt_hour("ct").alias("etTime"), start.alias("startWindowTime"), _bucket(buckets), "event_time", pt.alias("ptTime"), "userID", F.coalesce(F.col("fee").cast("long"), F.lit(0)).alias("fee"))
    fields = "traffic string, etTime string, startWindowTime long, ptTime long, orders long, users long, totalFee long"
    sums = rows.groupBy(*keys, "bucket").transformWithStateInPandas(IntervalSums(), f"event_time timestamp, {fields}", "append", "EventTime", None, "event_time")
    return sums.groupBy(*keys).transformWithStateInPandas(SoFar(), fields, "append", "EventTime")


class NewUsers(StatefulProcessor):
    """The number of users of a bucket that were not seen before; a state row for each user."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "userID string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = 0
        for user in pd.concat(list(rows), ignore_index=True)["userID"].dropna().unique():
            if not self.users.containsKey((user,)):
                self.users.updateValue((user,), (True,))
                new += 1
        yield pd.DataFrame([dict(zip(self.names, key, strict=False)) | {"users": new}])

    def close(self) -> None:
        pass


class UserSums(StatefulProcessor):
    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sum = handle.getValueState("sum", "users long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        users = (int(self.sum.get()[0]) if self.sum.exists() else 0) + sum(int(df["users"].sum()) for df in rows)
        self.sum.update((users,))
        yield pd.DataFrame([dict(zip(self.names, key, strict=True)) | {"users": users}])

    def close(self) -> None:
        pass


def distinct_users(df: DataFrame, keys: list[str], buckets: int = 16) -> DataFrame:
    """Exact distinct users of each key so far, after each micro-batch in which the key has rows."""
    rows = df.select(*(F.col(k).cast("string").alias(k) for k in keys), _bucket(buckets), "userID")
    fields = "".join(f"{k} string, " for k in keys) + "users long"
    new = rows.groupBy(*keys, "bucket").transformWithStateInPandas(NewUsers(keys), fields, "append", "None")
    return new.groupBy(*keys).transformWithStateInPandas(UserSums(keys), fields, "append", "None")
