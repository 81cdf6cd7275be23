"""All matches and the best of windows on streams; several sinks and late rows from one pass."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orderflow.functions import parse as p
from orderflow.operators import windows
from orderflow.plans import jobs
from orderflow.schemas import DIM_PRODUCT, DIM_PUB
from orderflow.streaming import fanout, sinks
from tests.test_operators import log, order, raw
from tests.test_streaming import DIM, FAR, files, run, stream

T0 = 1_591_328_158_000


def cut(rows, seed, out_of_order):
    """Three batches; rows less than that far apart may come in any order, over the cuts too."""
    rng = random.Random(seed)
    moved = sorted(range(len(rows)), key=lambda i: i + rng.random() * out_of_order)
    a, b = sorted(rng.sample(range(1, len(rows)), 2))
    return [[rows[i] for i in part] for part in (moved[:a], moved[a:b], moved[b:])]


@pytest.mark.parametrize(("seed", "times", "within", "keys"), [(0, 2, 9000, ["userID"]), (1, 3, 14_000, ["userID"]), (2, 2, 3500, [])])
def test_matches_on_a_stream_are_the_batch(spark, tmp_path, seed, times, within, keys):
    rng = random.Random(seed)
    rows = [log(f"s{i:03}", action="07", ct=T0 + 700 * (i - i % 2), duration=rng.choice(["60", "60", "3", "20"]), user=f"u{i % 3}", exts="") for i in range(70)]
    (src := tmp_path / "in").mkdir()
    files(src, *cut(rows, seed, 8), [log("far", action="07", ct=FAR, user="z", duration="20", exts="")])
    got = run(spark, jobs.dwell_matches(stream(spark, src), times=times, within_ms=within, keys=keys), tmp_path)
    want = jobs.dwell_matches(raw(spark, *rows), times=times, within_ms=within, keys=keys)
    assert got and sorted(got) == sorted(tuple(r) for r in want.collect())
    # Runs longer than the least give sub-runs.
    assert max(r[-1] for r in got) > times


def test_open_starts_are_dropped(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rows = [log(f"s{i}", action="07", ct=T0 + i, duration="60", user=f"u{i}", exts="") for i in range(6)]
    files(src, rows, *([log(f"far{i}", action="07", ct=FAR + i, user="z", duration="20", exts="")] for i in range(2)))
    q = jobs.dwell_matches(stream(spark, src), within_ms=1000).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for name in ("open", "place"):
        assert spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck")).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_best_of_windows_on_a_stream_is_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [order(f"{i:03}", T0 + 700 * i, fee=rng.randint(0, 3), product_id=f"P{rng.randint(0, 9)}", product_traffic=str(i % 2)) for i in range(150)]
    (src := tmp_path / "in").mkdir()
    files(src, *cut(rows, seed, 8), [order(999, FAR)])
    got = run(spark, jobs.best_of_windows(stream(spark, src), n=4), tmp_path)
    want = [tuple(r) for r in jobs.best_of_windows(raw(spark, *rows), n=4).collect()]
    assert got and sorted(got) == sorted(want)
    held = spark.read.format("statestore").option("stateVarName", "rows").option("flattenCollectionTypes", "true")
    assert all(held.option("operatorId", i).load(next(str(d) for d in tmp_path.iterdir() if d.name.startswith("t"))).count() <= 4 * 16 for i in (0, 1))


def test_a_failure_between_two_sinks_leaves_both_right(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    rows = [order(f"{i:03}", T0 + i, fee=i, product_id=f"P{i % 3}", product_pub="H1") for i in range(12)]
    rows[3]["product_fee"] = "x"
    files(src, rows[:5], rows[5:])
    products, pubs = spark.createDataFrame(DIM, DIM_PRODUCT), spark.createDataFrame([("H1", "n", "5", "g", "1")], DIM_PUB)
    table = sinks.Upserts(spark, f"file://{tmp_path}/index", "orderID", ["ct"])
    calls, fail = [], [("index", 1), ("topic", 0)]

    def put(name):
        def write(df, batch):
            calls.append((name, batch))
            if name == "index":
                table.write(df, batch)
            else:
                df.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={batch}")
            if (name, batch) in fail:
                fail.remove((name, batch))
                raise RuntimeError("lost between the sinks")
        return write

    seen = spark.sparkContext.accumulator(0)

    def counting(frames):
        for df in frames:
            seen.add(len(df))
            yield df

    for k in range(3):
        live = stream(spark, src).mapInPandas(counting, "value string")
        q = jobs.start(jobs.wide_everywhere(live, products, pubs, put("index"), put("topic"), put("rejects"), str(tmp_path / "ck")))
        try:
            q.awaitTermination(120)
            assert k == 2
        except Exception as e:
            assert "lost between the sinks" in str(e) and k < 2
    batch = raw(spark, *rows)
    wide = jobs.mwide(batch, products, pubs)
    assert sorted(r["orderID"] for r in table.read().collect()) == sorted(r["orderID"] for r in wide.collect()) and table.read().count() == 11
    topic = spark.read.parquet(f"{tmp_path}/topic").select("key", "value")
    assert sorted(map(tuple, topic.collect())) == sorted(map(tuple, sinks.messages(wide, "order_mwide").collect()))
    assert [json.loads(r["value"])["order_id"] for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == ["O003"]
    # What a batch has written is not written again, and what three sinks read is made once.
    assert [c for c in calls if c[1] == 0] == [("rejects", 0), ("index", 0), ("topic", 0), ("topic", 0)]
    assert [c for c in calls if c[1] == 1] == [("rejects", 1), ("index", 1), ("index", 1), ("topic", 1)]
    assert seen.value == 5 + 5 + 7 + 7


def test_what_comes_in_is_counted_or_late(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    first = [order(i, T0 + 1000 * i, fee=i) for i in range(30)]
    # Batch 2 knows of 41 s: all windows that end by 26 s are closed.
    t = T0 - T0 % 10_000
    batches = [first, [order(50, t + 41_000)], [order(90, t + 26_500), order(91, t + 100), order(92, t + 19_999, fee=3), order(93, t + 70_000)], [order(94, t + 100)], [order(95, t + 49_999), order(96, t + 50_000)]]
    files(src, *batches)
    store = fanout.RegionWindows(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        jobs.start(store.writer(p.accepted(p.parse_orders(stream(spark, src))), str(tmp_path / "ck"))).awaitTermination(120)
    late = {(r["orderID"], r["batch"], r["reject_reason"]) for r in store.late().collect()}
    assert late == {("O91", 2, "late"), ("O92", 2, "late"), ("O94", 3, "late"), ("O95", 4, "late")}
    every = [o for b in batches for o in b]
    assert store.windows().agg(F.sum("orders")).first()[0] + len(late) == len(every)
    counted = [o for o in every if o["order_id"] not in {x[0] for x in late}]
    want = windows.region_traffic(windows.with_event_time(p.accepted(p.parse_orders(raw(spark, *counted)))))
    columns = want.columns
    assert sorted(map(tuple, store.windows().select(*columns).collect())) == sorted(map(tuple, want.collect()))
