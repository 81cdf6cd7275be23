"""Every match of the run pattern, and the best rows of a window over all products, on streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import abnormal
from ..operators.windows import totals


class RunMatches(StatefulProcessor):
    """All matches of at least ``times`` abnormal views in a row, less than ``within`` from first to last.

    Views wait, by their time, until the watermark has passed them. The open starts are those
    of the present run that a later view can still be less than ``within`` away from; a
    normal view or time closes them.
    """

    def __init__(self, times: int, within_ms: int):
        self.times, self.within = times, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ct long", "rows string")
        self.open = handle.getListState("open", "sid string, ct long, place long")
        self.place = handle.getValueState("place", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        for ct, part in df.groupby("ct"):
            ct = int(ct)
            held = json.loads(self.waiting.getValue((ct,))[0]) if self.waiting.containsKey((ct,)) else []
            self.waiting.updateValue((ct,), (json.dumps(held + part[["sid", "bad"]].values.tolist()),))
            self.handle.registerTimer(ct)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ct = int(expiredTimerInfo.getExpiryTimeInMs())
        if not self.waiting.containsKey((ct,)):
            if self.open.exists() and all(ct - r[1] >= self.within for r in self.open.get()):
                self.open.clear()
                self.place.clear()
            return
        ready = sorted(json.loads(self.waiting.getValue((ct,))[0]))
        self.waiting.removeKey((ct,))
        starts = [tuple(r) for r in self.open.get() if ct - r[1] < self.within] if self.open.exists() else []
        place = int(self.place.get()[0]) if starts else 0  # places only tell how far apart open starts are
        out = []
        for sid, bad in ready:
            if not bad:
                starts, place = [], 0
                continue
            place += 1
            starts.append((sid, ct, place))
            out += [(s, sid, at, ct, place - first + 1) for s, at, first in starts if place - first >= self.times - 1]
        if starts:
            self.open.put(starts)
            self.place.update((place,))
            self.handle.registerTimer(ct + self.within)
        else:
            self.open.clear()
            self.place.clear()
        if out:
            startId, endId, startCt, endCt, events = zip(*out, strict=True)
            yield pd.DataFrame({"key": key[0], "startId": startId, "endId": endId, "startCt": startCt, "endCt": endCt, "events": events})

    def close(self) -> None:
        pass


def cep_matches(df: DataFrame, times: int = 2, within_ms: int = 180_000, low: int = 5, high: int = 50, keys: list[str] = ("userID",)) -> DataFrame:
    """The stream form of the matches, each as soon as the watermark passes its last view; ``df`` has ``event_time`` with its watermark.

    Without ``keys`` all views are one run in the order of time, and one group holds those
    that the watermark's delay lets wait.
    """
    key = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = df.select(key.alias("key"), "event_time", "sid", "ct", abnormal(low, high).alias("bad"))
    out = rows.groupBy("key").transformWithStateInPandas(RunMatches(times, within_ms), "key string, startId string, endId string, startCt long, endCt long, events long", "append", "EventTime")
    return out.select(*(F.get_json_object("key", f"$.{k}").alias(k) for k in keys), "startId", "endId", "startCt", "endCt", "events")


ROW = "productID string, traffic string, startWindowTime long, endWindowTime long, orders long, totalFee long"


class Best(StatefulProcessor):
    """The n best rows of a window, or of a part of it; the state is a list of n rows at most."""

    def __init__(self, n: int, size_ms: int, ranked: bool):
        self.n, self.size, self.ranked = n, size_ms, ranked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ROW.split(", ")]
        held = pd.DataFrame(list(self.rows.get()), columns=names) if self.rows.exists() else None
        every = pd.concat([x[names] for x in (held, *rows) if x is not None], ignore_index=True)
        every = every.sort_values(["orders", "totalFee", "productID", "traffic", "startWindowTime"], ascending=[False, False, True, True, True]).head(self.n)
        self.rows.put([(p, t, int(s), int(e), int(o), int(f)) for p, t, s, e, o, f in every.itertuples(index=False)])
        self.handle.registerTimer(int(key[0]) + self.size)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        self.rows.clear()
        if rows:
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ROW.split(", ")]).assign(window2=int(key[0]))
            # A part's rows have the end of the window for their time, so that they join its other parts in time.
            yield out.assign(rank=range(1, len(out) + 1)) if self.ranked else out.assign(event_time=pd.to_datetime(int(key[0]) + self.size, unit="ms", utc=True))

    def close(self) -> None:
        pass


def top_per_window(df: DataFrame, size: str, second_ms: int, n: int, parts: int = 16) -> DataFrame:
    """The ``n`` best products of each longer window, as a batch ranks them; ``df`` has ``event_time`` with its watermark.

    The totals of the short windows go to the best of one of ``parts`` hashed parts of the
    long window, and those to the window's.
    """
    keys = ["productID", "traffic"]
    first = df.groupBy(F.window("event_time", size).alias("w"), *keys).agg(*totals())
    start = F.unix_millis("w.start")
    rows = first.select(
        (start - F.pmod(start, F.lit(second_ms))).alias("window2"), F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part"), F.window_time("w").alias("event_time"),
        *keys, start.alias("startWindowTime"), F.unix_millis("w.end").alias("endWindowTime"), "orders", "totalFee",
    )
    best = rows.groupBy("window2", "part").transformWithStateInPandas(Best(n, second_ms, False), f"event_time timestamp, window2 long, {ROW}", "append", "EventTime", None, "event_time")
    out = best.groupBy("window2").transformWithStateInPandas(Best(n, second_ms, True), f"window2 long, {ROW}, rank long", "append", "EventTime")
    return out.select("window2", *keys, "startWindowTime", "endWindowTime", "orders", "totalFee", "rank")
