"""The same transforms over a stream of files give the batch's rows."""

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from orderflow import sources
from orderflow.functions import parse as p
from orderflow.operators import cep, logs, ranking, triggers, windows
from orderflow.plans import jobs
from orderflow.schemas import DIM_PRODUCT, DIM_PUB
from orderflow.streaming import aggregates, sinks, stateful
from tests.test_operators import log, order, raw

FAR = 4_000_000_000_000


def files(path, *batches):
    for i, rows in enumerate(batches):
        f = path / f"{i}.json"
        f.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(f, (1_000_000_000 + i, 1_000_000_000 + i))  # the order in which a stream reads them


def run(spark, df, tmp_path, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def stream(spark, path):
    return sources.json_lines(spark, f"file://{path}", stream=True, files_per_batch=1)


def orders_of(df):
    return windows.with_event_time(p.accepted(p.parse_orders(df)))


def test_windows_and_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = [order(i, 1000 * i, fee=i) for i in range(30)]
    inside, outside = order(90, 25_500), order(91, 100)
    files(src, first, [order(50, 41_000)], [inside, outside], [order(99, FAR)])
    got = run(spark, windows.region_traffic(orders_of(stream(spark, src))), tmp_path)
    kept = orders_of(raw(spark, *first, order(50, 41_000), inside))
    want = [tuple(r) for r in windows.region_traffic(kept).collect()]
    assert sorted(got) == sorted(want)


def test_count_trigger_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [order(f"{i:03}", 1000 + i, user=f"u{i % 4}", fee=i) for i in range(23)]
    files(src, rows[:5], rows[5:6], rows[6:])
    got = run(spark, stateful.stat_count(orders_of(stream(spark, src)), 60_000, 3), tmp_path)
    want = triggers.stat_count(orders_of(raw(spark, *rows)), 60_000, 3).select("traffic", "etTime", "startWindowTime", "orders", "users", "totalFee")
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_count_or_time_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [order(f"{i:03}", 7000 * i + 1, user=f"u{i % 4}", fee=i) for i in range(23)]
    files(src, rows[:9], rows[9:], [order(999, FAR)])
    typed = lambda df: orders_of(df).withColumns({"productType": F.lit("p"), "toursimType": F.lit("t")})
    got = run(spark, stateful.stat_count_or_time(typed(stream(spark, src)), 60_000, 4), tmp_path)
    names = ["productType", "toursimType", "startWindowTime", "endWindowTime", "orders", "users", "totalFee", "trigger"]
    want = triggers.stat_count_or_time(typed(raw(spark, *rows)), 60_000, 4).select(*names)
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_runs_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [log(f"s{i:03}", action="07", ct=1000 * i + 1, duration="20" if i % 5 == 0 else "60", user=f"u{i % 3}") for i in range(60)]
    files(src, rows[:20], rows[20:], [log("far", action="07", ct=FAR, user="z", duration="20")])
    typed = lambda df: windows.with_event_time(logs.page_views(p.parse_logs(df)))
    got = run(spark, stateful.cep_alerts(typed(stream(spark, src)), 2, 8000).select("sid"), tmp_path)
    want = cep.alerts(typed(raw(spark, *rows)), 2, 8000).select("sid").collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and got


def test_restart_from_checkpoint_upserts_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    table = sinks.Upserts(spark, f"file://{tmp_path}/table", "orderID", ["ct"])

    def start():
        df = p.accepted(p.parse_orders(stream(spark, src))).select("orderID", "fee", "ct")
        jobs.start(df.writeStream.foreachBatch(table.write).option("checkpointLocation", str(tmp_path / "ck"))).awaitTermination(60)

    files(src, [order(1, 1, fee=1), order(2, 1, fee=1)])
    start()
    (src / "9.json").write_text(json.dumps(order(1, 2, fee=7)) + "\n")
    start()
    start()
    assert sorted((r["orderID"], r["fee"]) for r in table.read().collect()) == [("O1", 7), ("O2", 1)]


DIM = [("P0", "A", "D1", "E1", "T", 3), ("P1", "B", "D2", "E1", "T", 3)]


@pytest.fixture
def replay(spark, tmp_path):
    """Orders and views as streams of three files, and the same rows as batches; the last order or view only moves the watermark."""
    t0 = 1591328158000
    orders = [order(f"{i:03}", t0 + 1700 * i, user=f"u{i % 4}", fee=i % 7, product_id=f"P{i % 3}", product_pub=f"H{i % 2}", user_region=f"R{i % 2}") for i in range(40)]
    ids = json.dumps({"targetID": "P1", "targetIDS": '["P1","P2"]'})
    views = [log(f"s{i:03}", action=("05", "07")[i % 4 > 0], event=("01", "02")[i % 8 > 0], ct=t0 + 1000 * i, duration="20" if i % 5 == 0 else "60", user=f"u{i % 3}", exts=ids) for i in range(60)]
    found = {}
    for name, rows, far in (("orders", orders, order(999, FAR)), ("views", views, log("far", action="07", ct=FAR, user="z", duration="20"))):
        (src := tmp_path / name).mkdir()
        files(src, rows[:13], rows[13:], [far])
        found[name] = (lambda src=src: stream(spark, src)), raw(spark, *rows), raw(spark, *rows, far)
    return found


AT_ONCE = [
    ("views", jobs.click_detail), ("views", jobs.page_view_detail), ("views", jobs.page_view_messages), ("views", jobs.list_view_messages), ("orders", jobs.order_detail_messages),
    ("orders", jobs.order_landing), ("orders", lambda o, dim, pub: jobs.wide_documents(o, dim)), ("orders", lambda o, dim, pub: jobs.wide_messages(o, dim)), ("orders", jobs.mwide),
    ("orders", lambda o: jobs.region_by_count(o, 3)), ("orders", lambda o, dim, pub: jobs.type_by_count(o, dim, 3)),
]
WINDOWED = [
    ("views", lambda v: jobs.dwell_alerts(v, within_ms=8000)), ("views", lambda v: jobs.dwell_alerts(v, within_ms=3000, keys=[])), ("orders", jobs.region_documents),
    ("orders", lambda o: jobs.hourly_by_count(o, n=3)), ("orders", lambda o, dim, pub: jobs.count_or_interval(o, dim, 60_000, 4)), ("orders", lambda o: jobs.top_products(o, n=2)),
    ("orders", lambda o, dim, pub: jobs.wide_type_messages(o, dim)),
]


@pytest.mark.parametrize("k", range(len(AT_ONCE) + len(WINDOWED)))
def test_every_job_on_a_stream_gives_the_batch(spark, tmp_path, replay, k):
    source, job = (AT_ONCE + WINDOWED)[k]
    dims = (spark.createDataFrame(DIM, DIM_PRODUCT), spark.createDataFrame([("H1", "n", "5", "g", "1")], DIM_PUB)) if job.__code__.co_argcount > 2 else ()
    live, rows, with_far = replay[source]
    got = run(spark, job(live(), *dims), tmp_path)
    want = [tuple(r) for r in job(with_far if k < len(AT_ONCE) else rows, *dims).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_running_jobs_show_the_batch_in_the_end(spark, tmp_path, replay):
    live, rows, with_far = replay["orders"]
    dim = spark.createDataFrame(DIM, DIM_PRODUCT)
    shown = {(r[0], r[1], r[2]): r for r in sorted(run(spark, jobs.hourly_by_time(live()), tmp_path, "update"), key=lambda r: r[3])}
    last = {}
    for r in jobs.hourly_by_time(with_far).orderBy("ptTime").collect():
        last[r["traffic"], r["etTime"], r["startWindowTime"]] = (r["orders"], r["users"], r["totalFee"])
    assert {k: tuple(r[3:]) for k, r in shown.items()} == last
    totals = {}
    for r in sorted(run(spark, jobs.departure_totals(live(), dim), tmp_path, "complete"), key=lambda r: r[1]):
        totals[r[0]] = r
    assert totals == {r["depCode"]: tuple(r) for r in jobs.departure_totals(with_far, dim).collect()}
    store = {}
    put = lambda df, batch: store.update((r["key"], r["value"]) for r in df.collect())
    jobs.start(sinks.to_store(jobs.region_cache(live()), put, str(tmp_path / "kv"))).awaitTermination(120)
    assert store == {r["key"]: r["value"] for r in jobs.region_cache(with_far).collect()}


def test_a_dimension_is_read_again_while_the_job_runs(spark, tmp_path, replay):
    live, *_ = replay["orders"]
    now, out = [0.0], []

    def read():
        now[0] += 60.0  # each use finds the time over
        return spark.createDataFrame([("P0", f"type at {now[0]:.0f}", "D", "E", "T", 1)], DIM_PRODUCT)

    put = lambda df, batch: out.append({r["productType"] for r in df.where("productID = 'P0'").collect()})
    writer = jobs.refreshed(live(), jobs.wide_documents, [sources.Refreshed(read, 60, lambda: now[0])], put, str(tmp_path / "ck"))
    jobs.start(writer).awaitTermination(120)
    assert out[:2] == [{"type at 60"}, {"type at 120"}]


def test_state_is_dropped_at_the_end_of_the_window(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [order(f"{i:03}", 1000 + i, fee=1) for i in range(4)]
    files(src, rows, [order("b", 500_000)], [order("late", 2000)], [order("c", 500_001)])
    df = stateful.stat_count(orders_of(stream(spark, src)), 60_000, 2)
    q = df.writeStream.format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["startWindowTime"], r["orders"]) for r in spark.table("dropped").collect()) == [(0, 2), (0, 4), (480_000, 2)]
    held = spark.read.format("statestore").option("stateVarName", "totals").load(str(tmp_path / "ck")).collect()
    assert len(held) == 1


def test_chained_ranks_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [order(f"{i:03}", 1 + 900 * i, fee=i % 7, product_id=f"P{i % 2}") for i in range(60)]
    files(src, rows[:25], rows[25:], [order(999, FAR)])
    got = run(spark, aggregates.top_per_key(orders_of(stream(spark, src)), "10 seconds", "30 seconds", 2), tmp_path)
    names = ["window2", "productID", "traffic", "startWindowTime", "endWindowTime", "orders", "totalFee", "rank"]
    want = ranking.top_per_key(windows.product_traffic(orders_of(raw(spark, *rows))), 30_000, 2).select(*names)
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_totals_are_shown_again_in_update_mode(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [order(f"{i:03}", 1 + 1000 * i, user=f"u{i % 3}", fee=i) for i in range(10)]
    files(src, rows[:4], rows[4:])
    got = run(spark, aggregates.stat_time(orders_of(stream(spark, src))), tmp_path, "update")
    assert sorted(r[3:] for r in got) == [(4, 3, 6), (10, 3, 45)]
    last = triggers.stat_time(orders_of(raw(spark, *rows)), 60_000).first()
    assert (last["orders"], last["users"], last["totalFee"], last["startWindowTime"]) == (*sorted(got)[-1][3:], got[0][2])


def test_a_job_runs_at_processing_time_intervals(spark, tmp_path, replay):
    live, _, with_far = replay["orders"]
    shown = []
    writer = jobs.hourly_by_time(live()).writeStream.foreachBatch(lambda df, batch: shown.append(df.agg(F.max("orders")).first()[0])).outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
    q = jobs.start(writer, "1 second")
    try:
        until = time.monotonic() + 60
        while len([x for x in shown if x]) < 2 and time.monotonic() < until:
            time.sleep(0.2)
        assert q.isActive and [x for x in shown if x][:2] == [13, 40]
    finally:
        q.stop()
