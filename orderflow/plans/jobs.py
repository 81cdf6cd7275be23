"""The job catalogue: each job is a DataFrame-to-DataFrame pipeline over raw messages in ``value``.

All of them take a batch or a stream; where Spark's batch form can't run on a stream,
the job takes the operator's stream form. ``start`` runs a job's stream into a sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions import fmt_iso, key_concat
from ..functions.parse import accepted, parse_logs, parse_orders, parse_view_list, rejected
from ..operators import cep, enrich, logs, ranking, triggers, windows
from ..sources import Refreshed
from ..streaming import aggregates, clock, fanout, patterns, sinks, stateful, totals, versions


def orders_of(raw: DataFrame) -> DataFrame:
    return windows.with_event_time(accepted(parse_orders(raw)))


def wide_orders(raw: DataFrame, products: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Orders with their product, for the aggregates.

    With a column ``valid_from`` the products are versions, and an order takes the one of its
    time. As a stream they are changes that come while the job runs, after the versions of
    ``initial``; else the dimension is what it was at the start.
    """
    if enrich.VALID_FROM not in products.columns:
        return enrich.join_product_left(orders_of(raw), products)
    if raw.isStreaming and products.isStreaming:
        return versions.join_versions(accepted(parse_orders(raw)), products, initial)
    return enrich.join_product_versions(orders_of(raw), products)


def click_detail(raw: DataFrame) -> DataFrame:
    """Documents for an upsert by sid."""
    return logs.valid(logs.check_logs(logs.click_exts(logs.clicks(parse_logs(raw)))))


def page_view_detail(raw: DataFrame) -> DataFrame:
    return logs.valid(logs.check_logs(logs.page_view_exts(logs.page_views(parse_logs(raw)))))


def page_view_messages(raw: DataFrame) -> DataFrame:
    return sinks.messages(logs.page_view_exts(logs.page_views(parse_logs(raw))), "page_view")


def list_view_messages(raw: DataFrame) -> DataFrame:
    return sinks.messages(logs.explode_view_list(logs.list_views(parse_view_list(raw))), "view_list_fact")


def dwell_alerts(raw: DataFrame, **options) -> DataFrame:
    """Options are those of ``cep.alerts``; ``keys=[]`` runs over all views."""
    views = windows.with_event_time(logs.page_view_exts(logs.page_views(parse_logs(raw))))
    found = stateful.cep_alerts(views, **options) if raw.isStreaming else cep.alerts(views, **options)
    return sinks.messages(found.drop("sid"), "page_view_alert")


def order_detail_messages(raw: DataFrame) -> DataFrame:
    return sinks.messages(accepted(parse_orders(raw)), "order_detail")


def wide_documents(raw: DataFrame, products: DataFrame) -> DataFrame:
    return logs.valid(logs.check_documents(enrich.join_product_left(accepted(parse_orders(raw)), products)))


def wide_messages(raw: DataFrame, products: DataFrame) -> DataFrame:
    return sinks.messages(enrich.join_product_inner(accepted(parse_orders(raw)), products), "order_wide")


def mwide(raw: DataFrame, products: DataFrame, pubs: DataFrame) -> DataFrame:
    return enrich.join_product_pub(accepted(parse_orders(raw)), products, pubs)


def order_landing(raw: DataFrame) -> DataFrame:
    return sinks.landing(accepted(parse_orders(raw)))


def region_cache(raw: DataFrame, size: str = "10 seconds") -> DataFrame:
    """key and value of each region's latest window; on a stream of each window that changes, for ``sinks.to_store``."""
    out = windows.region_traffic(orders_of(raw), size)
    return sinks.keyed(out, "userRegion", "traffic") if raw.isStreaming else sinks.key_values(out, "userRegion", "traffic")


def region_documents(raw: DataFrame, size: str = "10 seconds") -> DataFrame:
    out = windows.region_traffic(orders_of(raw), size)
    return out.withColumns({"startTime": fmt_iso("startWindowTime"), "endTime": fmt_iso("endWindowTime"), "id": key_concat("userRegion", "traffic")})


def wide_type_messages(raw: DataFrame, products: DataFrame, size: str = "10 seconds", time: str = "event", initial: DataFrame | None = None) -> DataFrame:
    """``time="clock"`` puts a stream's orders into the window in which they arrive; a batch has but event time."""
    wide = wide_orders(raw, products, initial)
    if time == "clock" and raw.isStreaming:
        out = clock.clock_windows(wide, ["productType", "toursimType"], windows.milliseconds(size))
    else:
        out = windows.wide_type(wide, size)
    return sinks.messages(out, "order_wide_agg")


def departure_totals(raw: DataFrame, products: DataFrame) -> DataFrame:
    wide = enrich.join_product_left(accepted(parse_orders(raw)), products)
    return windows.departures(logs.valid(logs.check_orders(wide))).withColumn("ct", fmt_iso("ct"))


def accumulated_totals(raw: DataFrame, products: DataFrame, stored: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Stored totals by departure with the orders' added; on a stream those that a micro-batch changed, in append mode.

    ``stored`` is what the store holds when the job starts with a fresh checkpoint: depCode, orders, fee and ct in ms.
    """
    valid = logs.valid(logs.check_orders(wide_orders(raw, products, initial)))
    out = totals.accumulate(valid, stored) if raw.isStreaming else windows.accumulated(stored, windows.departures(valid))
    return out.withColumn("time", fmt_iso("ct"))


def hourly_by_count(raw: DataFrame, size_ms: int = 60_000, n: int = 50) -> DataFrame:
    form = stateful.stat_count if raw.isStreaming else triggers.stat_count
    return form(orders_of(raw), size_ms, n).withColumn("id", F.concat_ws("_", "traffic", "etTime"))


def hourly_by_time(raw: DataFrame, interval_ms: int = 60_000) -> DataFrame:
    """Totals at the end of each interval; on a stream the totals so far, shown at each trigger of the query in update mode."""
    return aggregates.stat_time(orders_of(raw)) if raw.isStreaming else triggers.stat_time(orders_of(raw), interval_ms)


def hourly_at_intervals(raw: DataFrame, interval_ms: int = 60_000) -> DataFrame:
    """Totals so far at the end of each interval of event time, with ``ptTime``; a stream gives the batch's rows, in append mode."""
    form = totals.stat_time if raw.isStreaming else triggers.stat_time
    return form(orders_of(raw), interval_ms).withColumn("id", F.concat_ws("_", "traffic", "etTime", "ptTime"))


def count_or_interval(raw: DataFrame, products: DataFrame, interval_ms: int, n: int, time: str = "event", initial: DataFrame | None = None) -> DataFrame:
    """``time="clock"`` flushes a stream's open batch when the clock passes the interval's end, also if no more orders come."""
    form = triggers.stat_count_or_time
    if raw.isStreaming:
        form = clock.stat_count_or_time if time == "clock" else stateful.stat_count_or_time
    return form(wide_orders(raw, products, initial), interval_ms, n)


def region_by_count(raw: DataFrame, n: int) -> DataFrame:
    form = stateful.count_windows if raw.isStreaming else windows.count_windows
    return form(orders_of(raw), ["userRegion", "traffic"], n)


def type_by_count(raw: DataFrame, products: DataFrame, n: int) -> DataFrame:
    form = stateful.count_windows if raw.isStreaming else windows.count_windows
    return form(enrich.join_product_left(orders_of(raw), products), ["productType", "toursimType"], n)


def top_products(raw: DataFrame, size: str = "10 seconds", second_ms: int = 30_000, n: int = 30) -> DataFrame:
    if raw.isStreaming:
        best = aggregates.top_per_key(orders_of(raw), size, f"{second_ms} milliseconds", n)
    else:
        best = ranking.top_per_key(windows.product_traffic(orders_of(raw), size), second_ms, n)
    return sinks.messages(best.select("productID", "traffic", "startWindowTime", "endWindowTime", "orders", "totalFee"), "order_topn")


def best_of_windows(raw: DataFrame, size: str = "10 seconds", second_ms: int = 30_000, n: int = 30) -> DataFrame:
    """The best products of each longer window over all products."""
    if raw.isStreaming:
        return patterns.top_per_window(orders_of(raw), size, second_ms, n)
    return ranking.top_per_window(windows.product_traffic(orders_of(raw), size), second_ms, n)


def dwell_matches(raw: DataFrame, **options) -> DataFrame:
    """Every run of abnormal views, by its first and last; options are those of ``cep.matches``."""
    views = windows.with_event_time(logs.page_view_exts(logs.page_views(parse_logs(raw))))
    return patterns.cep_matches(views, **options) if raw.isStreaming else cep.matches(views, **options)


def wide_everywhere(raw: DataFrame, products: DataFrame, pubs: DataFrame, index: Callable, topic: Callable, rejects: Callable, checkpoint: str) -> DataStreamWriter:
    """Orders with both dimensions to the index and the topic, and what can't be read to the rejects, from one pass.

    Each of the three gets (rows, batch): documents, messages, and raw values with a reason.
    """
    wide = lambda rows: enrich.join_product_pub(accepted(rows), products, pubs)
    return fanout.fan_out(parse_orders(raw), [
        fanout.Sink("rejects", rejected, rejects),
        fanout.Sink("index", lambda rows: logs.valid(logs.check_documents(wide(rows))), index),
        fanout.Sink("topic", lambda rows: sinks.messages(wide(rows), "order_mwide"), topic),
    ], checkpoint)


def start(writer: DataStreamWriter, every: str | None = None) -> StreamingQuery:
    """Starts a job's writer: at each processing-time interval ``every``, else over all that is there, and then ends.

    ``writer`` comes from ``sinks`` or is a frame's ``writeStream`` with its checkpoint.
    """
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def refreshed(raw: DataFrame, job: Callable[..., DataFrame], dimensions: list[Refreshed], put: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that runs ``job(messages, *dimensions)`` on each micro-batch, with the dimensions read again after their time, and gives its rows to ``put``.

    For jobs without state: enriched documents and messages.
    """

    def write(rows: DataFrame, batch: int) -> None:
        put(job(rows, *(d.get() for d in dimensions)), batch)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
