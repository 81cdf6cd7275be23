"""A job that gets new sums goes on from the checkpoint it had before."""

import json

import pytest
from pyspark.sql import functions as F

from orderflow.functions import parse as p
from orderflow.operators import windows
from orderflow.plans import jobs
from orderflow.streaming import stateful, totals
from tests.test_operators import order
from tests.test_streaming import FAR, files, stream

T0 = 1_591_328_160_000


def rows_of(df):
    df = windows.with_event_time(p.accepted(p.parse_orders(df)))
    return df.withColumns({"productType": F.lit("p"), "toursimType": F.lit("t"), "depCode": F.lit("D"), "people": F.lit(2)})


JOBS = [
    (lambda df, more: stateful.stat_count(df, 60_000, 2, more), "orders", {2: None, 4: 2, 6: 6}),
    (lambda df, more: stateful.count_windows(df, ["userRegion", "traffic"], 4, more), "batch", {0: 2}),
    (lambda df, more: stateful.stat_count_or_time(df, 60_000, 4, more), "trigger", {"count": 2, "timer": 6}),
    (lambda df, more: totals.accumulate(df, None, more), "orders", {3: None, 7: 8}),
]


@pytest.mark.parametrize("k", range(4))
def test_a_checkpoint_from_before_a_sum_was_added(spark, tmp_path, k):
    """Three orders come before the job knows of ``people``, and four after: those three count zero for it."""
    job, key, want = JOBS[k]
    (src := tmp_path / "in").mkdir()
    before = {n: spark.conf.get(n, None) for n in ("spark.sql.streaming.stateStore.encodingFormat",)}
    stateful.configure(spark, evolving=True)
    got = {}

    def run(more):
        out = job(rows_of(stream(spark, src)), more)
        put = lambda df, batch: got.update((r[key], r["people"] if more else None) for r in df.collect())
        jobs.start(out.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck"))).awaitTermination(120)

    try:
        files(src, [order(i, T0 + i) for i in range(3)])
        run([])
        for name, rows in (("5", [order(i, T0 + i) for i in range(3, 7)]), ("6", [order(99, FAR)])):
            if k == 2 or name == "5":
                (src / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        run(["people"])
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    assert got == want
