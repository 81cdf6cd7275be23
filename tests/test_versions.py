"""Versioned dimensions, stored totals and exact users under state: streams give the batch's rows."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderflow import sources
from orderflow.functions import parse as p
from orderflow.operators import enrich, triggers, windows
from orderflow.plans import jobs
from orderflow.schemas import DIM_PRODUCT
from orderflow.streaming import sinks, totals, versions
from tests.test_operators import order, raw
from tests.test_streaming import FAR, files, orders_of, run, stream

VERSIONED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DIM_PRODUCT.fields) + ", valid_from long"
T0 = 1_591_328_158_000


def version(i, kind, at, dep="D1"):
    return (i, kind, dep, "E1", "T", 3, at)


def changes_of(spark, path):
    return sources.json_lines(spark, f"file://{path}", stream=True, files_per_batch=1).select(F.from_json("value", VERSIONED).alias("c")).select("c.*")


def as_json(v):
    return dict(zip([f.split(" ")[0] for f in VERSIONED.split(", ")], v, strict=True))


@pytest.fixture
def changing(spark, tmp_path):
    """Orders in three files, out of order inside each, and changes that come with them; the last order moves the watermark."""
    rng = random.Random(1)
    orders = [order(f"{i:03}", T0 + 900 * i, user=f"u{i % 5}", fee=i % 7, product_id=f"P{i % 3}") for i in range(60)]
    parts = [orders[:20], orders[20:40], orders[40:]]
    for x in parts:
        rng.shuffle(x)
    initial = [version("P0", "A", 0), version("P1", "B", T0 + 5000, "D2")]
    changes = [[version("P0", "A2", T0 + 9000, "D3")], [version("P1", "B2", T0 + 27_000), version("P1", "B1", T0 + 27_000)], [version("P0", "A3", T0 + 50_000), version("P2", "C", T0 + 45_000, "D2")]]
    (src := tmp_path / "orders").mkdir(), (dim := tmp_path / "changes").mkdir()
    files(src, *parts, [order(999, FAR)])
    files(dim, *([as_json(v) for v in c] for c in changes), [])
    batch = spark.createDataFrame(initial + [v for c in changes for v in c], VERSIONED)
    return (lambda: stream(spark, src)), (lambda: changes_of(spark, dim)), spark.createDataFrame(initial, VERSIONED), raw(spark, *orders), batch


def plain(orders, rows):
    """Each order's productType by looking through all versions."""
    out = {}
    for o in orders:
        held = sorted((v[6], json.dumps(v), v[1]) for v in rows if v[0] == o["productID"] and v[6] <= o["ct"])
        out[o["orderID"]] = max((v for v in held if v[0] == held[-1][0]), key=lambda v: v[2])[2] if held else "-1"
    return out


@pytest.mark.parametrize("salts", [1, 4])
def test_orders_take_the_version_of_their_time(spark, tmp_path, changing, salts):
    orders, changes, initial, batch, every = changing
    live = versions.join_versions(p.accepted(p.parse_orders(orders())), changes(), initial, salts)
    got = {r[0]: r for r in run(spark, live.select("orderID", "productType", "productLevel", "depCode", "fee", "ct"), tmp_path)}
    wide = enrich.join_product_versions(orders_of(batch), every)
    want = {r[0]: tuple(r) for r in wide.select("orderID", "productType", "productLevel", "depCode", "fee", "ct").collect()}
    got.pop("O999", None)
    assert got == want
    assert {k: v[1] for k, v in want.items()} == plain(orders_of(batch).collect(), [tuple(r) for r in every.collect()])
    assert {v[1] for v in want.values()} == {"A", "A2", "A3", "B", "B2", "C", "-1"}


def test_aggregates_follow_the_versions(spark, tmp_path, changing):
    orders, changes, initial, batch, every = changing
    for job in (lambda o, d, **k: jobs.wide_type_messages(o, d, **k), lambda o, d, **k: jobs.count_or_interval(o, d, 20_000, 4, **k)):
        got = run(spark, job(orders(), changes(), initial=initial), tmp_path)
        want = [tuple(r) for r in job(batch, every).collect()]
        assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_old_versions_are_dropped(spark, tmp_path, changing):
    orders, changes, initial, *_ = changing
    live = versions.join_versions(p.accepted(p.parse_orders(orders())), changes(), initial)
    q = live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = spark.read.format("statestore").option("stateVarName", "versions").load(str(tmp_path / "ck"))
    counts = defaultdict(int)
    for r in held.collect():
        counts[r["key"]["key"]] += 1
    assert counts == {"P0": 1, "P1": 1, "P2": 1}


def test_orders_wait_in_pieces(spark, tmp_path):
    """P0 has more orders of one time than a piece holds, P1 many times; the stream ends within a piece and goes on from its checkpoint."""
    rows = [order(f"a{i:05}", T0 + 10_000 * (i % 3), product_id="P0") for i in range(3 * versions.PIECE + 3000)]
    rows += [order(f"b{i:05}", T0 + 30 * i, product_id="P1") for i in range(600)]
    random.Random(3).shuffle(rows)
    later = [order("c", T0 + 30_000, product_id="P0"), order("d", T0 + 30_000, product_id="P2")]
    first = [version(f"P{i}", f"A{i}", 0) for i in range(50)]
    told = [version("P0", "B", T0 + 10_000), version("P1", "C", T0 + 9000), version("P1", "D", T0 + 12_000)]
    (src := tmp_path / "orders").mkdir(), (dim := tmp_path / "changes").mkdir()
    files(src, rows)
    files(dim, [as_json(v) for v in told])
    initial = spark.createDataFrame(first, VERSIONED)

    def go():
        live = versions.join_versions(p.accepted(p.parse_orders(stream(spark, src))), changes_of(spark, dim), initial)
        live.select("orderID", "productType").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)

    def held(name):
        counts = defaultdict(int)
        for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck")).select("key").collect():
            counts[r["key"]["key"]] += 1
        return counts

    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == versions.PIECE + 1000 + 167  # to T0 + 5000
    pieces = held("waiting")
    assert pieces["P1"] == 1 and pieces["P0"] <= 6 and set(held("versions")) == {"P0", "P1"}
    for i, x in enumerate([later, [order(999, FAR, product_id="P9")]]):
        (src / f"later{i}.json").write_text("".join(json.dumps(r) + "\n" for r in x))
    go()
    got = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = enrich.join_product_versions(orders_of(raw(spark, *rows, *later)), spark.createDataFrame(first + told, VERSIONED))
    assert got == {r["orderID"]: r["productType"] for r in want.collect()}
    assert set(got.values()) == {"A0", "A1", "A2", "B", "C", "D"} and held("waiting") == {"P9": 1}


def test_versions_with_gaps_and_nulls(spark):
    rows = [("P0", "A", "D", None, None, None, 100), ("P0", "B", "D", "E", "T", 2, 200), (None, "X", "D", "E", "T", 1, 0), ("P1", "Y", "D", "E", "T", 1, None)]
    found = enrich.join_product_versions(orders_of(raw(spark, *(order(i, ct, product_id=f"P{i % 2}") for i, ct in enumerate([99, 99, 100, 100, 199, 0, 200, 5])))), spark.createDataFrame(rows, VERSIONED))
    assert sorted((r["orderID"], r["productType"], r["desCode"]) for r in found.collect()) == [
        ("O0", "-1", "-1"), ("O1", "-1", "-1"), ("O2", "A", None), ("O3", "-1", "-1"), ("O4", "A", None), ("O5", "-1", "-1"), ("O6", "B", "E"), ("O7", "-1", "-1")]


DIM = [("P0", "A", "D1", "E1", "T", 3), ("P1", "B", "D2", "E1", "T", 3)]


def test_stored_totals_are_added_to_once(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rows = [order(f"{i:03}", 1000 + i, fee=i, product_id=f"P{i % 3}") for i in range(30)]
    files(src, rows[:10], rows[10:20])
    dim = spark.createDataFrame(DIM, DIM_PRODUCT)
    stored = spark.createDataFrame([("D1", 100, 1000, 5), ("D9", 7, 70, 8_000_000)], "depCode string, orders long, fee long, ct long")
    table = sinks.Upserts(spark, f"file://{tmp_path}/table", "depCode", ["orders"])
    table.write(stored.withColumn("time", F.lit("")), -1)
    fail = [True]

    def put(df, batch):
        table.write(df, batch)
        if batch == 1 and fail.pop():
            fail.append(False)
            raise RuntimeError("lost after the write")

    def start():
        df = jobs.accumulated_totals(stream(spark, src), dim, stored)
        q = df.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert "lost after the write" in str(e)

    start()
    fail[:] = [False]
    start()  # the batch that was lost is run again and adds nothing
    f = src / "9.json"
    f.write_text("".join(json.dumps(r) + "\n" for r in rows[20:]))
    start()
    want = jobs.accumulated_totals(raw(spark, *rows), dim, stored)
    got = table.read().select("depCode", "orders", "fee", "ct")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("depCode", "orders", "fee", "ct").collect()))
    assert {r["depCode"]: r["orders"] for r in got.collect()} == {"D1": 110, "D2": 10, "-1": 10, "D9": 7}


def test_interval_totals_with_users_equal_the_batch(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rng = random.Random(2)
    rows = [order(f"{i:03}", T0 + 2500 * i, user=f"u{rng.randint(0, 12)}", fee=i, product_traffic=str(i % 2)) for i in range(120)]
    parts = [rows[:40], rows[40:44], rows[44:90], rows[90:]]
    for x in parts:
        rng.shuffle(x)
    files(src, *parts, [order(999, FAR)])
    got = run(spark, jobs.hourly_at_intervals(stream(spark, src), 30_000), tmp_path)
    batch = jobs.hourly_at_intervals(raw(spark, *rows), 30_000)
    names = ["traffic", "etTime", "startWindowTime", "ptTime", "orders", "users", "totalFee", "id"]
    assert got and sorted(got) == sorted(tuple(r) for r in batch.select(*names).collect())


def test_user_state_is_one_row_each_and_goes_with_the_day(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rows = [order(f"{i:03}", T0 + i, user=f"u{i % 40}", fee=1) for i in range(80)]
    files(src, rows)
    df = lambda: totals.stat_time(orders_of(stream(spark, src)), 60_000, buckets=3)
    state = lambda: spark.read.format("statestore").option("stateVarName", "users").option("operatorId", 1).load(str(tmp_path / "ck")).count()
    sizes = []
    for _ in range(2):
        df().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        sizes.append(state())
        (src / "far.json").write_text(json.dumps(order(999, FAR)) + "\n")
    assert sizes[0] == 40 and sizes[1] <= 1


def test_distinct_users_on_a_stream(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rows = [order(f"{i:03}", T0 + i, user=f"u{i * i % 17}", fee=1, user_region=f"R{i % 2}") for i in range(50)]
    files(src, rows[:20], rows[20:21], rows[21:])
    got = {}
    for region, n in sorted(run(spark, totals.distinct_users(p.accepted(p.parse_orders(stream(spark, src))), ["userRegion"], 4), tmp_path), key=lambda r: r[1]):
        got[region] = n
    assert got == {r[0]: r[1] for r in windows.distinct_users(orders_of(raw(spark, *rows)), ["userRegion"]).collect()}
    assert triggers.stat_time(orders_of(raw(spark, *rows)), 60_000).count() > 0
