"""Flushes by the processing-time clock: on an idle source, after a restart, and beside the count."""

import time
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from orderflow.operators import windows
from orderflow.plans import jobs
from orderflow.schemas import DIM_PRODUCT
from orderflow.streaming import clock
from tests.test_operators import order
from tests.test_streaming import files, orders_of, stream


def started(df, ck, every="300 milliseconds"):
    name = f"t{uuid.uuid4().hex}"
    return name, df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(ck)).trigger(processingTime=every).start()


def until(spark, name, done, seconds=60):
    end = time.monotonic() + seconds
    while True:
        rows = spark.table(name).collect()
        if done(rows) or time.monotonic() > end:
            return rows
        time.sleep(0.2)


def typed(df):
    return orders_of(df).withColumns({"productType": F.lit("p"), "toursimType": F.col("userID")})


def test_an_idle_source_is_flushed_at_the_boundary(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    files(src, [order(f"{i:03}", 1000 + i, user="ab"[i % 2], fee=i) for i in range(11)])
    interval = 4000
    name, q = started(clock.stat_count_or_time(typed(stream(spark, src)), interval, 4), tmp_path / "ck")
    try:
        rows = until(spark, name, lambda r: sum(x["orders"] for x in r) == 11)
        arrived = next(datetime.fromisoformat(p["timestamp"]).timestamp() * 1000 for p in q.recentProgress if p["numInputRows"])
    finally:
        q.stop()
    # a: 0 2 4 6 by count, 8 10 by the clock; b: 1 3 5 7 by count, 9 by the clock.
    assert sorted((r["toursimType"], r["trigger"], r["orders"], r["totalFee"], r["startWindowTime"]) for r in rows) == [
        ("a", "count", 4, 12, 1000), ("a", "timer", 2, 18, 1008), ("b", "count", 4, 16, 1001), ("b", "timer", 1, 9, 1009)]
    ends = {r["endWindowTime"] for r in rows if r["trigger"] == "timer"}
    # The boundary is the first after the arrival, and nothing else came to bring it about.
    assert len(ends) == 1 and (end := ends.pop()) % interval == 0 and arrived < end <= arrived + interval
    # Nothing is left: neither rows nor a timer.
    for state in ("open", "due"):
        assert spark.read.format("statestore").option("stateVarName", state).load(str(tmp_path / "ck")).count() == 0


def test_a_restart_loses_no_open_batch(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    files(src, [order(f"{i:03}", 1000 + i, user="a", fee=1) for i in range(3)])
    df = lambda: clock.stat_count_or_time(typed(stream(spark, src)), 15_000, 10)
    # Close to a boundary there would be no time to stop before it.
    while time.time() * 1000 % 15_000 > 6000:
        time.sleep(0.2)
    out = tmp_path / "out"
    run = lambda: df().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    q = run()
    end = time.monotonic() + 60
    while not (q.lastProgress and any(s.get("numRowsTotal") for s in q.lastProgress["stateOperators"])) and time.monotonic() < end:
        time.sleep(0.1)
    q.stop()
    schema = "orders long, totalFee long, trigger string"
    assert spark.read.schema(schema).parquet(str(out)).count() == 0
    q, end = run(), time.monotonic() + 60
    try:
        while not (rows := spark.read.schema(schema).parquet(str(out)).collect()) and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert [(r["orders"], r["totalFee"], r["trigger"]) for r in rows] == [(3, 3, "timer")]


def test_windows_of_the_clock_hold_every_order_once(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rows = [order(f"{i:03}", 1000 + i, user="ab"[i % 2], fee=i - 3, adult="2") for i in range(20)]
    files(src, rows[:7], rows[7:12], rows[12:])
    keyed = typed(stream(spark, src)).withColumn("productType", F.lit(None).cast("string"))
    name, q = started(clock.clock_windows(keyed, ["productType", "toursimType"], 1000), tmp_path / "ck")
    try:
        out = until(spark, name, lambda r: sum(x["orders"] for x in r) == 20)
    finally:
        q.stop()
    assert all(r["endWindowTime"] - r["startWindowTime"] == 999 and r["startWindowTime"] % 1000 == 0 and r["productType"] is None for r in out)
    for user, fees in (("a", range(-3, 17, 2)), ("b", range(-2, 17, 2))):
        mine = [r for r in out if r["toursimType"] == user]
        assert sum(r["totalFee"] for r in mine) == sum(fees) and sum(r["orders"] for r in mine) == 10 and max(r["maxFee"] for r in mine) == max(fees)
        assert all(r["avgFee"] == int(r["totalFee"] / r["orders"]) and r["maxFee"] >= 0 for r in mine)
        assert len({r["startWindowTime"] for r in mine}) == len(mine)


def test_jobs_take_the_clock(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    files(src, [order(f"{i:03}", 1000 + i, user="a", fee=1, product_id="P0") for i in range(5)])
    dim = spark.createDataFrame([("P0", "A", "D1", "E1", "T", 3)], DIM_PRODUCT)
    one, q1 = started(jobs.count_or_interval(stream(spark, src), dim, 1000, 3, time="clock"), tmp_path / "c1")
    two, q2 = started(jobs.wide_type_messages(stream(spark, src), dim, "1 second", time="clock"), tmp_path / "c2")
    try:
        assert sorted((r["trigger"], r["orders"], r["productType"]) for r in until(spark, one, lambda r: len(r) == 2)) == [("count", 3, "A"), ("timer", 2, "A")]
        assert ['"orders":"5"' in r["value"] for r in until(spark, two, lambda r: r)] == [True]
    finally:
        q1.stop()
        q2.stop()
    # A batch has no arrival times: the clock is its event time.
    raw = spark.read.text(str(src))
    assert jobs.count_or_interval(raw, dim, 1000, 3).count() == 2
    assert windows.milliseconds("10 seconds") == 10_000 and windows.milliseconds("2 hours") == 7_200_000
