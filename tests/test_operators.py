"""Edge cases of the operators on hand-made rows."""

import json
import random

from pyspark.sql import functions as F

from orderflow import sources
from orderflow.functions import json_out, key_partition
from orderflow.functions import parse as p
from orderflow.operators import cep, enrich, logs, ranking, triggers, windows
from orderflow.plans import jobs
from orderflow.schemas import DIM_PRODUCT, DIM_PUB, ORDER_WIRE
from orderflow.streaming import sinks

WIRE = {
    "order_id": "O1", "user_id": "U1", "product_id": "P25", "product_pub": "H3", "user_mobile": "100", "user_region": "R1", "product_traffic": "01", "product_traffic_grade": "11",
    "product_traffic_type": "01", "product_price": "80", "product_fee": "160", "has_activity": "0", "travel_member_adult": "2", "travel_member_yonger": "0", "travel_member_baby": "1", "order_ct": "1591328158000",
}


def raw(spark, *records):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in records], "value string")


def order(i, ct, user="u", fee=1, **more):
    return WIRE | {"order_id": f"O{i}", "order_ct": str(ct), "user_id": user, "product_fee": str(fee)} | more


def orders(spark, *records):
    return windows.with_event_time(p.accepted(p.parse_orders(raw(spark, *records))))


def test_every_missing_key(spark):
    rows = [{k: v for k, v in WIRE.items() if k != gone} for gone in WIRE]
    out = p.parse_orders(raw(spark, *rows)).collect()
    for gone, r in zip(WIRE, out, strict=True):
        name = ORDER_WIRE[gone]
        if name in ("price", "fee", "ct"):
            assert r["reject_reason"] == name and r[name] is None
        else:
            assert r["reject_reason"] is None and r[name] == ""


def test_malformed_and_null_messages_are_rejected(spark):
    df = raw(spark, WIRE | {"product_fee": "x"}, "not json", "", None, WIRE)
    parsed = p.parse_orders(df)
    assert p.accepted(parsed).count() == 1
    assert [r["reject_reason"] for r in p.rejected(parsed).collect()] == ["fee"] + ["price,fee,ct"] * 3


def test_hour_key(spark):
    from orderflow.functions import fmt_hour, fmt_pattern

    df = spark.createDataFrame([(1591328158000,), (0,)], "ct long")
    got = df.select(fmt_hour("ct").alias("h"), fmt_pattern("ct", "yyyy").alias("y")).collect()
    assert got[0]["h"] == "2020060503" and [r["y"] for r in got] == ["2020", None]


def test_average_truncates_and_max_fee_is_never_negative(spark):
    out = windows.region_traffic(orders(spark, order(1, 1000, fee=1), order(2, 2000, fee=2), order(3, 3000, fee=4))).first()
    assert (out["orders"], out["totalFee"], out["avgFee"], out["members"]) == (3, 7, 2.0, 9)
    assert windows.region_traffic(orders(spark, order(1, 1000, fee=-5))).first()["maxFee"] == 0


PRODUCT = [("P25", "A", "D1", "E1", "T", 3), ("P25", "B", "D1", "E1", "T", 3), ("P26", None, "D2", "E2", "T", 4), (None, "X", "D", "E", "T", 1)]


def test_joins_with_defaults_duplicates_and_null_attributes(spark):
    dim, pub = spark.createDataFrame(PRODUCT, DIM_PRODUCT), spark.createDataFrame([("H3", "n", "5", "g", "1")], DIM_PUB)
    df = orders(spark, order(1, 1), order(2, 2, product_id="none", product_pub="none"), order(3, 3, product_id="P26"))
    left = {r["orderID"]: r for r in enrich.join_product_left(df, dim).collect()}
    assert len(left) == 3 and left["O1"]["productType"] == "B"
    assert [left["O2"][c] for c in ("productLevel", "productType", "toursimType", "depCode", "desCode")] == [-1, "-1", "-1", "-1", "-1"]
    assert left["O3"]["productType"] is None and left["O3"]["depCode"] == "D2"
    assert {r["orderID"] for r in enrich.join_product_inner(df, dim).collect()} == {"O1", "O3"}
    assert [r["orderID"] for r in enrich.unmatched_products(df, dim).collect()] == ["O2"]
    both = {r["orderID"]: r for r in enrich.join_product_pub(df, dim, pub).collect()}
    assert [both["O2"][c] for c in ("productLevel", "productType", "depCode", "pubStar", "isNational")] == [0, "", "", "", ""]
    assert both["O1"]["pubStar"] == "5"


def log(sid, action="05", event="02", exts="", ct=1, duration="60", user="u", **more):
    return {"sid": sid, "userID": user, "action": action, "eventType": event, "exts": exts, "ct": ct, "duration": duration} | more


def test_list_explosion(spark):
    exts = json.dumps({"travelTime": 5, "targetIDS": json.dumps(["P40", "P46", "P28", "P62"])})
    rows = [log("a", event="01", exts=exts), log("b", event="04", exts=json.dumps({"targetIDS": "[]"})), log("c", event="01", exts=""), log("d", event="01", exts=json.dumps({"targetIDS": ["P1"]})), log("e", event="01", exts="{}"), log("f", event="03", exts=exts)]
    out = logs.explode_view_list(logs.list_views(p.parse_view_list(raw(spark, *rows)))).collect()
    assert sorted((r["sid"], r["targetID"]) for r in out) == [("a", "P28"), ("a", "P40"), ("a", "P46"), ("a", "P62"), ("d", "P1")]
    assert {r["travelTime"] for r in out if r["sid"] == "a"} == {"5"}


def test_click_exts_and_validation(spark):
    rows = [log("a", exts=json.dumps({"targetID": "P25", "eventTargetType": "01"})), log("b", exts=""), log("c", action=None), log("d", ct=None, exts="{}")]
    df = p.parse_logs(raw(spark, *rows))
    out = {r["sid"]: (r["targetID"], r["eventTargetType"]) for r in logs.click_exts(logs.clicks(df)).collect()}
    assert out == {"a": ("P25", "01"), "b": ("", ""), "d": ("", "")}
    assert {r["sid"]: r["reject_reason"] for r in logs.invalid(logs.check_logs(df)).collect()} == {"c": "action", "d": "ct"}


def test_durations_at_the_bounds(spark):
    df = p.parse_logs(raw(spark, *(log(d, duration=d) for d in ("", "4", "5", "50", "51", "x"))))
    assert {r["sid"] for r in df.where(logs.abnormal(5, 50)).collect()} == {"4", "51"}


def test_stat_count_and_compat(spark):
    df = orders(spark, *(order(i, 1000 + i, u) for i, u in enumerate("aabbc")))
    get = lambda x: [(r["orders"], r["users"], r["totalFee"]) for r in x.orderBy("orders").collect()]
    assert get(triggers.stat_count(df, 60_000, 2)) == [(2, 1, 2), (4, 2, 4)]
    assert get(triggers.stat_count(df, 60_000, 2, compat=True)) == [(2, 1, 2), (6, 2, 6)]
    assert get(triggers.stat_count(df, 60_000, 2, emit_remainder=True))[-1] == (5, 3, 5)


def test_count_or_time(spark):
    df = orders(spark, *(order(i, 1000 * i, u) for i, u in enumerate("abc"))).withColumns({"productType": F.lit("p"), "toursimType": F.lit("t")})
    out = triggers.stat_count_or_time(df, 60_000, 2).orderBy("startWindowTime").collect()
    assert [(r["orders"], r["trigger"], r["startWindowTime"], r["endWindowTime"]) for r in out] == [(2, "count", 0, 1000), (1, "timer", 2000, 60_000)]


def test_top_ties_collapse(spark):
    rows = [("p", "t", 0, 10_000, 5, 50), ("p", "t", 10_000, 20_000, 5, 50), ("p", "t", 20_000, 30_000, 4, 90)]
    df = spark.createDataFrame(rows, "productID string, traffic string, startWindowTime long, endWindowTime long, orders long, totalFee long")
    out = ranking.top_per_key(df, 30_000, 30).orderBy("rank").collect()
    assert [(r["orders"], r["startWindowTime"]) for r in out] == [(5, 0), (4, 20_000)]
    assert ranking.top_per_window(df, 30_000, 2).count() == 2


def test_json_out(spark):
    df = spark.createDataFrame([(3, None, 1)], "orders long, x string, i int")
    assert df.select(json_out(df).alias("v")).first()["v"] == '{"orders":"3","x":null,"i":1}'


def brute(rows, times, within, key):
    """All matches over sorted rows: (start id, end id)."""
    out = set()
    for k in {key(r) for r in rows}:
        own = sorted((r for r in rows if key(r) == k), key=lambda r: (r["ct"], r["sid"]))
        bad = [int(r["duration"]) < 5 or int(r["duration"]) > 50 for r in own]
        for i in range(len(own)):
            for j in range(i + times - 1, len(own)):
                if all(bad[i : j + 1]) and own[j]["ct"] - own[i]["ct"] < within:
                    out.add((own[i]["sid"], own[j]["sid"]))
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(1)
    for times in (2, 3):
        rows = [log(f"s{i:03}", action="07", ct=rng.randrange(200), duration=rng.choice(["1", "60", "20", "2"]), user=rng.choice("ab")) for i in range(120)]
        df = logs.page_views(p.parse_logs(raw(spark, *rows)))
        for keys, key in ((["userID"], lambda r: r["userID"]), ([], lambda r: 0)):
            want = brute(rows, times, 25, key)
            got = cep.matches(df, times, 25, keys=keys).collect()
            assert {(r["startId"], r["endId"]) for r in got} == want and len(got) == len(want)
            own = sorted(rows, key=lambda r: (r["ct"], r["sid"]))
            hit = set()
            for a, b in want:
                k = key(next(r for r in rows if r["sid"] == a))
                ids = [r["sid"] for r in own if key(r) == k]
                hit |= set(ids[ids.index(a) : ids.index(b) + 1])
            assert sorted(r["sid"] for r in cep.alerts(df, times, 25, keys=keys).collect()) == sorted(hit)


def test_strict_bound_and_break(spark):
    views = lambda *x: logs.page_views(p.parse_logs(raw(spark, *(log(f"s{t}", action="08", ct=t * 1000, duration=d) for t, d in x))))
    assert sorted(r["ct"] for r in cep.alerts(views((0, "60"), (60, "60"), (90, "20"), (100, "60"))).collect()) == [0, 60_000]
    assert cep.alerts(views((0, "60"), (180, "60"))).count() == 0


def test_upsert_replays(spark, tmp_path):
    t = sinks.Upserts(spark, f"file://{tmp_path}/t", "id", ["ct"])
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v long, ct long")
    t.write(rows(("a", 1, 1), ("a", 2, 2), (None, 9, 9)), 0)
    t.write(rows(("a", 0, 0), ("b", 5, 1)), 1)
    t.write(rows(("a", 0, 0), ("b", 5, 1)), 1)
    t.write(rows(("b", 6, 1)), 2)
    assert sorted((r["id"], r["v"]) for r in t.read().collect()) == [("a", 2), ("b", 6)]


def java_hash(text):
    h = 0
    for c in text:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_partitions_of_messages(spark):
    rows = [("polygenelubricants", "v"), ("a", "v"), ("", "v"), ("key", None), ("0cc175b9c0f1b6a831c399e269772661", "v")]
    got = spark.createDataFrame(rows, "key string, value string").select("key", "value", key_partition("key", "value", 12).alias("p")).collect()
    assert [r["p"] for r in got] == [abs(java_hash(k)) % 12 if v else 11 for k, v in rows] and java_hash("polygenelubricants") == -(2**31)
    out = sinks.messages(orders(spark, order(1, 1000)), "order_detail", 7)
    assert out.columns == ["key", "value", "partition"] and 0 <= out.first()["partition"] < 7


def test_sessions_and_count_windows_over_block_edges(spark):
    day = 86_400_000
    at = [0, 9_999, 20_000, day - 6_000, day - 1, day + 5_000, day + 30_000, 2 * day - 10_000, 2 * day]
    df = orders(spark, *(order(i, t, fee=i) for i, t in enumerate(at)))
    whole = windows._windowed(df, ["traffic"], F.session_window("event_time", "10 seconds"), windows.m4(), True, True)
    blocks = windows.session_traffic(df, "10 seconds")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect())) and blocks.count() == 5
    df = orders(spark, *(order(f"{i:03}", 1000 * (i * 7919 % 500), fee=i, user_region=None if i % 3 else "R") for i in range(200)))
    a, b = (windows.count_windows(df, ["userRegion", "traffic"], 6, block) for block in (20_000, 86_400_000))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 33


def test_each_message_is_parsed_once(spark):
    df = p.parse_orders(raw(spark, WIRE))
    for out in (p.accepted(df), p.rejected(df), p.accepted(df).select("fee"), logs.clicks(p.parse_logs(raw(spark, WIRE)))):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_plans_of_ranks_and_joins(spark):
    df = orders(spark, *(order(i, 1000 * i) for i in range(5)))
    plan = windows.count_windows(df, ["traffic"], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(traffic" in plan and "_block" in plan.split("row_number() windowspecdefinition(", 1)[1].split(")")[0]
    dim = spark.createDataFrame(PRODUCT, DIM_PRODUCT).cache()
    dim.count()
    assert "strategy=broadcast" in enrich.join_product_left(df, dim)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in enrich.sized(dim, 1)._jdf.queryExecution().optimizedPlan().toString()


def test_landing(spark, tmp_path):
    sinks.land(orders(spark, order(1, 1591328158000)).drop("event_time"), f"file://{tmp_path}/o")
    assert (tmp_path / "o" / "dt_hour=2020060503").is_dir()


def test_refresh(spark):
    now, reads = [0.0], []

    def read():
        reads.append(1)
        return spark.range(len(reads))

    dim = sources.Refreshed(read, 60, lambda: now[0])
    assert dim.get().count() == 1 and dim.get().count() == 1
    now[0] = 60.0
    assert dim.get().count() == 2


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([("P1", 3)], "product_id string, product_level int").write.format("jdbc").options(url=url, dbtable="dim_product", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    out = sources.jdbc(spark, url, 'SELECT * FROM dim_product', "org.apache.derby.iapi.jdbc.AutoloadedDriver").collect()
    assert [tuple(r) for r in out] == [("P1", 3)]


def test_kafka_options():
    assert sources.kafka_options("s", "t", "latest", 5)["startingOffsets"] == "latest"


def test_jobs_run_end_to_end(spark):
    dim, pub = spark.createDataFrame(PRODUCT, DIM_PRODUCT), spark.createDataFrame([("H3", "n", "5", "g", "1")], DIM_PUB)
    o = raw(spark, *(order(i, 1591328158000 + i) for i in range(4)), order(9, 1, product_fee="x"))
    views = raw(spark, *(log(f"s{i}", action="07", ct=i, exts="{}") for i in range(3)), log("c", exts="{}"))
    for df, n in [
        (jobs.click_detail(views), 1), (jobs.page_view_detail(views), 3), (jobs.page_view_messages(views), 3), (jobs.list_view_messages(views), 0), (jobs.dwell_alerts(views), 3),
        (jobs.order_detail_messages(o), 4), (jobs.wide_documents(o, dim), 4), (jobs.wide_messages(o, dim), 4), (jobs.mwide(o, dim, pub), 4), (jobs.order_landing(o), 4),
        (jobs.region_cache(o), 1), (jobs.region_documents(o), 1), (jobs.wide_type_messages(o, dim), 1), (jobs.departure_totals(o, dim), 1), (jobs.hourly_by_count(o, n=2), 2),
        (jobs.hourly_by_time(o), 1), (jobs.count_or_interval(o, dim, 60_000, 3), 2), (jobs.top_products(o), 1),
    ]:
        assert df.count() == n
