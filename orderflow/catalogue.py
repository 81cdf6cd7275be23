"""Every registered query with its SQL.

Window sizes fit the tables' event density: one event in minutes, so that the
seconds of the live jobs become hours here. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fmt_hour, fmt_iso, fmt_pattern, json_out, key_concat, key_md5, key_partition, key_sanitize
from .functions import parse as p
from .operators import cep, enrich, logs, ranking, triggers, windows
from .plans import adapters as a
from .plans import live
from .schemas import ORDER_DETAIL, TOPN
from .streaming import patterns, sinks, stateful, totals, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000, 86_400_000


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _start(ms: int, column: str = "ct") -> str:
    return f"{column} - {column} % {ms}"


ORDERS = '"orderID", "userID", "productID", "pubID", "userMobile", "userRegion", traffic, "trafficGrade", "trafficType", "hasActivity", adult, yonger, baby, price, fee, ct'
M4 = 'count(*) AS orders, greatest(max(fee), 0) AS "maxFee", CAST(sum(fee) AS BIGINT) AS "totalFee", CAST(sum(members) AS BIGINT) AS members, CAST(sum(fee) // count(*) AS DOUBLE) AS "avgFee"'
TOTALS = 'count(*) AS orders, CAST(sum(fee) AS BIGINT) AS "totalFee"'
HOUR_SQL = "strftime(epoch_ms(ct), '%Y%m%d%H')"

# Parsing and formats


@query("parse_order", a.with_sql(f"SELECT {ORDERS} FROM event_orders WHERE ct % 50 <> 0", "event_orders"))
def parse_order(spark, d):
    return p.accepted(p.parse_orders(a.order_messages(spark, d)))


@query("parse_order_rejects", a.with_sql('SELECT "orderID", \'fee\' AS reject_reason FROM event_orders WHERE ct % 50 = 0', "event_orders"))
def parse_order_rejects(spark, d):
    return p.rejected(p.parse_orders(a.order_messages(spark, d))).select(F.get_json_object("value", "$.order_id").alias("orderID"), "reject_reason")


WIDE = '"productLevel", "productType", "toursimType", "depCode", "desCode"'


@query("parse_wide", a.with_sql(f"SELECT {ORDERS.replace('fee', 'fee')}, {WIDE} FROM wide", "event_orders", "products", "wide"))
def parse_wide(spark, d):
    wide = enrich.join_product_left(a.event_orders(spark, d), a.products(spark, d)).drop("event_time")
    return p.accepted(p.parse_wide(wide.select(json_out(wide).alias("value"))))


@query("parse_log", a.with_sql('SELECT sid, "userDevice", "userID", "userRegion", "userRegionIP", duration, action, "eventType", ct FROM event_logs', "event_logs"))
def parse_log(spark, d):
    return p.parse_logs(a.log_messages(spark, d)).select("sid", "userDevice", "userID", "userRegion", "userRegionIP", "duration", "action", "eventType", "ct")


@query("parse_view_list", a.with_sql('SELECT sid, "userID", action, "eventType", ct, "hotTarget" FROM event_logs', "event_logs"))
def parse_view_list(spark, d):
    return p.parse_view_list(a.log_messages(spark, d)).select("sid", "userID", "action", "eventType", "ct", "hotTarget")


@query("parse_results", a.with_sql(f'SELECT "productID", traffic, {_start(DAY)} AS "startWindowTime", {_start(DAY)} + {DAY} AS "endWindowTime", {TOTALS} FROM event_orders GROUP BY ALL', "event_orders"))
def parse_results(spark, d):
    out = windows.product_traffic(a.event_orders(spark, d), "1 day")
    return p.parse(sinks.messages(out, "order_topn"), TOPN)


@query("fmt_hour", a.with_sql(f'SELECT "orderID", {HOUR_SQL} AS "etTime" FROM event_orders', "event_orders"))
def q_fmt_hour(spark, d):
    return a.event_orders(spark, d).select("orderID", fmt_hour("ct").alias("etTime"))


@query("fmt_iso", a.with_sql("SELECT \"orderID\", strftime(epoch_ms(ct), '%Y-%m-%dT%H:%M:%S') || '+0000' AS iso FROM event_orders", "event_orders"))
def q_fmt_iso(spark, d):
    return a.event_orders(spark, d).select("orderID", fmt_iso("ct").alias("iso"))


@query("fmt_pattern", a.with_sql("SELECT \"orderID\", strftime(epoch_ms(ct), '%Y/%m/%d') AS day FROM event_orders", "event_orders"))
def q_fmt_pattern(spark, d):
    return a.event_orders(spark, d).select("orderID", fmt_pattern("ct", "yyyy/MM/dd").alias("day"))


@query("key_md5", a.with_sql('SELECT "orderID", md5("productID" || traffic) AS key FROM event_orders', "event_orders"))
def q_key_md5(spark, d):
    return a.event_orders(spark, d).select("orderID", key_md5("productID", "traffic").alias("key"))


@query("key_concat", a.with_sql('SELECT "orderID", "userRegion" || \'_\' || traffic AS key FROM event_orders', "event_orders"))
def q_key_concat(spark, d):
    return a.event_orders(spark, d).select("orderID", key_concat("userRegion", "traffic").alias("key"))


@query("key_sanitize", a.with_sql("SELECT sid, replace(\"userRegionIP\", '.', '_') AS key FROM event_logs", "event_logs"))
def q_key_sanitize(spark, d):
    return a.event_logs(spark, d).select("sid", key_sanitize("userRegionIP").alias("key"))


@query("key_partition", a.with_sql(f"""SELECT "orderID", CASE WHEN h > 2147483648 THEN 4294967296 - h ELSE h END % 12 AS partition FROM (
  SELECT "orderID", list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(md5("productID" || traffic), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM event_orders)""", "event_orders"))
def q_key_partition(spark, d):
    o = a.event_orders(spark, d).withColumn("key", key_md5("productID", "traffic"))
    return o.select("orderID", key_partition("key", "userID", 12).alias("partition"))


@query("json_out", a.with_sql("""SELECT '{"orderID":"' || "orderID" || '","fee":' || fee || ',"ct":"' || ct || '"}' AS value FROM event_orders""", "event_orders"))
def q_json_out(spark, d):
    o = a.event_orders(spark, d).select("orderID", "fee", "ct")
    return o.select(json_out(o).alias("value"))


# Logs

CLICKS = """action = '05' AND "eventType" = '02'"""
VIEWS = "action IN ('07', '08')"
LISTS = """action = '05' AND "eventType" IN ('01', '04')"""


@query("flt_click", a.with_sql(f"SELECT sid FROM event_logs WHERE {CLICKS}", "event_logs"))
def flt_click(spark, d):
    return logs.clicks(a.event_logs(spark, d)).select("sid")


@query("flt_page_view", a.with_sql(f"SELECT sid FROM event_logs WHERE {VIEWS}", "event_logs"))
def flt_page_view(spark, d):
    return logs.page_views(a.event_logs(spark, d)).select("sid")


@query("flt_view_list", a.with_sql(f"SELECT sid FROM event_logs WHERE {LISTS}", "event_logs"))
def flt_view_list(spark, d):
    return logs.list_views(a.event_logs(spark, d)).select("sid")


@query("ext_click", a.with_sql(f'SELECT sid, "userID", "targetID", "eventTargetType", ct FROM event_logs WHERE {CLICKS}', "event_logs"))
def ext_click(spark, d):
    return logs.click_exts(logs.clicks(a.event_logs(spark, d))).select("sid", "userID", "targetID", "eventTargetType", "ct")


@query("ext_page_view", a.with_sql(f'SELECT sid, "userID", duration, "targetID", ct FROM event_logs WHERE {VIEWS}', "event_logs"))
def ext_page_view(spark, d):
    return logs.page_view_exts(logs.page_views(a.event_logs(spark, d))).select("sid", "userID", "duration", "targetID", "ct")


@query("explode_view_list", a.with_sql(f"""SELECT sid, "hotTarget", 'D' || (k % 10) AS "travelSend", CAST(k % 5 AS VARCHAR) AS "travelTime", '' AS "productType", 'P' || (k + i) AS "targetID"
FROM event_logs, (SELECT unnest([1, 2, 3]) AS i) WHERE {LISTS} AND i <= k % 4""", "event_logs"))
def explode_view_list(spark, d):
    return logs.explode_view_list(logs.list_views(a.event_logs(spark, d))).select("sid", "hotTarget", "travelSend", "travelTime", "productType", "targetID")


NULLED = "CASE WHEN ct % 13 = 0 THEN NULL ELSE action END"


@query("flt_valid_log", a.with_sql(f"SELECT sid, {NULLED} AS action, CASE WHEN ct % 13 = 0 THEN 'action' END AS reject_reason FROM event_logs", "event_logs"))
def flt_valid_log(spark, d):
    return logs.check_logs(a.event_logs(spark, d).withColumn("action", F.expr(NULLED))).select("sid", "action", "reject_reason")


@query("flt_valid_order", a.with_sql('SELECT "orderID" FROM event_orders WHERE ct % 11 <> 0', "event_orders"))
def flt_valid_order(spark, d):
    o = a.event_orders(spark, d).withColumn("productID", F.expr("CASE WHEN ct % 11 = 0 THEN NULL ELSE productID END"))
    return logs.valid(logs.check_orders(o)).select("orderID")


@query("flt_valid_doc", a.with_sql('SELECT "orderID", fee FROM event_orders WHERE ct % 11 <> 0', "event_orders"))
def flt_valid_doc(spark, d):
    o = a.event_orders(spark, d).withColumn("orderID", F.expr("CASE WHEN ct % 11 = 0 THEN '' ELSE orderID END"))
    return logs.valid(logs.check_documents(o)).select("orderID", "fee")


@query("flt_abnormal_duration", a.with_sql(f"SELECT sid, duration FROM event_logs WHERE {VIEWS} AND (seconds < 5 OR seconds > 50)", "event_logs"))
def flt_abnormal_duration(spark, d):
    return logs.page_views(a.event_logs(spark, d)).where(logs.abnormal(5, 50)).select("sid", "duration")


# Joins

STAR = '"orderID", "userID", "productID", "pubID", "userRegion", traffic, fee, ct'


def _star(df: DataFrame, *more: str) -> DataFrame:
    return df.select("orderID", "userID", "productID", "pubID", "userRegion", "traffic", F.col("fee").cast("long").alias("fee"), "ct", *more)


WIDE_COLUMNS = ("productLevel", "productType", "toursimType", "depCode", "desCode")


@query("join_product_left", a.with_sql(f"SELECT {STAR}, {WIDE} FROM wide", "star_orders", "products", "wide", orders="star_orders"))
def join_product_left(spark, d):
    return _star(enrich.join_product_left(a.star_orders(spark, d), a.products(spark, d)), *WIDE_COLUMNS)


@query("join_product_inner", a.with_sql(f"""SELECT {STAR}, {WIDE} FROM wide WHERE "productType" <> '-1'""", "star_orders", "products", "wide", orders="star_orders"))
def join_product_inner(spark, d):
    return _star(enrich.join_product_inner(a.star_orders(spark, d), a.products(spark, d)), *WIDE_COLUMNS)


@query("join_product_unmatched", a.with_sql(f"""SELECT {STAR} FROM event_orders WHERE "pubID" NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)""", "event_orders"))
def join_product_unmatched(spark, d):
    """Orders of a user's own hotel; there are more users than hotels."""
    hotel = a.event_orders(spark, d).withColumns({"own": F.col("productID"), "productID": F.col("pubID")})
    return _star(enrich.unmatched_products(hotel, a.hotel_products(spark, d)).withColumn("productID", F.col("own")))


@query("join_hotel_left", a.with_sql(f"""SELECT {STAR}, CASE WHEN s_suppkey IS NULL THEN '-1' ELSE s_name END AS "productType", CASE WHEN s_suppkey IS NULL THEN -1 ELSE s_nationkey % 5 END AS "productLevel"
FROM event_orders LEFT JOIN supplier ON "pubID" = CAST(s_suppkey AS VARCHAR)""", "event_orders"))
def join_hotel_left(spark, d):
    """The left join where some orders have no match."""
    hotel = a.event_orders(spark, d).withColumns({"own": F.col("productID"), "productID": F.col("pubID")})
    return _star(enrich.join_product_left(hotel, a.hotel_products(spark, d)).withColumn("productID", F.col("own")), "productType", "productLevel")


@query("join_hotel_inner", a.with_sql(f"""SELECT {STAR}, s_name AS "productType", s_nationkey % 5 AS "productLevel" FROM event_orders JOIN supplier ON "pubID" = CAST(s_suppkey AS VARCHAR)""", "event_orders"))
def join_hotel_inner(spark, d):
    """The inner join where some orders have no match and go."""
    hotel = a.event_orders(spark, d).withColumns({"own": F.col("productID"), "productID": F.col("pubID")})
    return _star(enrich.join_product_inner(hotel, a.hotel_products(spark, d)).withColumn("productID", F.col("own")), "productType", "productLevel")


VERSIONED = f"""SELECT "orderID", ct, "productID", product_type AS "productType", product_level + CASE WHEN ct >= {a.LATER} + {a.STAGGER} * CAST(product_id AS BIGINT) THEN 100 ELSE 0 END AS "productLevel",
  CASE WHEN ct >= {a.LATER} + {a.STAGGER} * CAST(product_id AS BIGINT) THEN 'L' ELSE '' END || departure_code AS "depCode" FROM event_orders JOIN products ON "productID" = product_id"""


@query("join_product_versions", a.with_sql(VERSIONED, "event_orders", "products"))
def join_product_versions(spark, d):
    """Each order with the version of its product that held at its time."""
    wide = enrich.join_product_versions(a.event_orders(spark, d), a.product_versions(spark, d))
    return wide.select("orderID", "ct", "productID", "productType", "productLevel", "depCode")


@query("join_product_pub", a.with_sql(f"""SELECT {STAR}, coalesce(product_level, 0) AS "productLevel", coalesce(product_type, '') AS "productType", coalesce(toursim_tickets_type, '') AS "toursimType",
  coalesce(departure_code, '') AS "depCode", coalesce(des_city_code, '') AS "desCode", coalesce(pub_star, '') AS "pubStar", coalesce(pub_grade, '') AS "pubGrade", coalesce(is_national, '') AS "isNational"
FROM star_orders LEFT JOIN products ON "productID" = product_id LEFT JOIN pubs ON "pubID" = pub_id""", "star_orders", "products", "pubs"))
def join_product_pub(spark, d):
    return _star(enrich.join_product_pub(a.star_orders(spark, d), a.products(spark, d), a.pubs(spark, d)), *WIDE_COLUMNS, "pubStar", "pubGrade", "isNational")


@query("dim_dedup", "SELECT CAST(p_partkey % 50 AS VARCHAR) AS product_id, max(p_partkey) AS version FROM part GROUP BY 1")
def dim_dedup(spark, d):
    dim = a._table(spark, d, "part").select(F.expr("cast(p_partkey % 50 as string)").alias("product_id"), F.col("p_partkey").alias("version"), "p_type")
    return enrich.dedup(dim, "product_id", "version").select("product_id", "version")


# Windows


@query("win_region_traffic", a.with_sql(f'SELECT "userRegion", traffic, {_start(HOUR)} AS "startWindowTime", {_start(HOUR)} + {HOUR} AS "endWindowTime", {M4} FROM event_orders GROUP BY 1, 2, 3, 4', "event_orders"))
def win_region_traffic(spark, d):
    return windows.region_traffic(a.event_orders(spark, d), "1 hour")


@query("win_product_traffic", a.with_sql(f'SELECT "productID", traffic, {_start(DAY)} AS "startWindowTime", {_start(DAY)} + {DAY} AS "endWindowTime", {TOTALS} FROM event_orders GROUP BY 1, 2, 3, 4', "event_orders"))
def win_product_traffic(spark, d):
    return windows.product_traffic(a.event_orders(spark, d), "1 day")


@query("win_wide_type", a.with_sql(f'SELECT "productType", "toursimType", {_start(30 * DAY)} AS "startWindowTime", {_start(30 * DAY)} + {30 * DAY - 1} AS "endWindowTime", {M4} FROM wide GROUP BY 1, 2, 3, 4', "star_orders", "products", "wide", orders="star_orders"))
def win_wide_type(spark, d):
    return windows.wide_type(enrich.join_product_left(a.star_orders(spark, d), a.products(spark, d)), "30 days")


@query("win_session_traffic", a.with_sql(f"""SELECT traffic, min(ct) AS "startWindowTime", max(ct) + {20 * 60_000 - 1} AS "endWindowTime", {M4} FROM (
  SELECT *, sum(n) OVER (PARTITION BY traffic ORDER BY ct, "orderID") AS s FROM (
    SELECT *, CASE WHEN ct - lag(ct) OVER (PARTITION BY traffic ORDER BY ct, "orderID") < {20 * 60_000} THEN 0 ELSE 1 END AS n FROM event_orders)) GROUP BY traffic, s""", "event_orders"))
def win_session_traffic(spark, d):
    return windows.session_traffic(a.event_orders(spark, d).withColumn("event_time", F.timestamp_millis("ct")), "20 minutes")


@query("win_sliding", a.with_sql(f"""SELECT "userRegion", traffic, s AS "startWindowTime", s + {HOUR} AS "endWindowTime", {M4} FROM (
  SELECT *, {_start(HOUR // 2)} - i * {HOUR // 2} AS s FROM event_orders, (SELECT unnest([0, 1]) AS i)) GROUP BY 1, 2, 3, 4""", "event_orders"))
def win_sliding(spark, d):
    return windows.region_traffic(a.event_orders(spark, d), "1 hour", "30 minutes")


def _count_sql(keys: str, n: int) -> str:
    fields = M4.replace("sum(members)", "sum(members)")
    return f"""SELECT {keys}, batch, CAST(0 AS BIGINT) AS "startWindowTime", {windows.MAX_LONG} AS "endWindowTime", {fields} FROM (
  SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY ct, "orderID") - 1) // {n} AS batch FROM source) GROUP BY {keys}, batch HAVING count(*) = {n}"""


@query("cnt_region_traffic", a.with_sql(_count_sql('"userRegion", traffic', 10).replace("source", "event_orders"), "event_orders"))
def cnt_region_traffic(spark, d):
    return windows.count_windows(a.event_orders(spark, d), ["userRegion", "traffic"], 10)


@query("cnt_wide_type", a.with_sql(_count_sql('"productType", "toursimType"', 10).replace("source", "wide"), "event_orders", "products", "wide"))
def cnt_wide_type(spark, d):
    return windows.count_windows(enrich.join_product_left(a.event_orders(spark, d), a.products(spark, d)), ["productType", "toursimType"], 10)


RUNNING = f"""run AS (SELECT traffic, "etTime", "startWindowTime", CAST(sum(fee) OVER w AS BIGINT) AS "totalFee", row_number() OVER w AS orders, CAST(sum(new) OVER w AS BIGINT) AS users FROM (
  SELECT *, {HOUR_SQL} AS "etTime", {_start(HOUR)} AS "startWindowTime",
    CASE WHEN row_number() OVER (PARTITION BY traffic, {HOUR_SQL}, {_start(HOUR)}, "userID" ORDER BY ct, "orderID") = 1 THEN 1 ELSE 0 END AS new FROM event_orders)
  WINDOW w AS (PARTITION BY traffic, "etTime", "startWindowTime" ORDER BY ct, "orderID" ROWS UNBOUNDED PRECEDING))"""


@query("stat_count", a.with_sql(f'SELECT * FROM (WITH {RUNNING} SELECT traffic, "etTime", "startWindowTime", orders, users, "totalFee" FROM run WHERE orders % 2 = 0)', "event_orders"))
def stat_count(spark, d):
    return triggers.stat_count(a.event_orders(spark, d), HOUR, 2)


@query("stat_count_compat", a.with_sql(f"""SELECT * FROM (WITH {RUNNING} SELECT traffic, "etTime", "startWindowTime", users, CAST(sum(orders) OVER w AS BIGINT) AS orders, CAST(sum("totalFee") OVER w AS BIGINT) AS "totalFee" FROM run WHERE orders % 2 = 0
  WINDOW w AS (PARTITION BY traffic, "etTime", "startWindowTime" ORDER BY run.orders ROWS UNBOUNDED PRECEDING))""", "event_orders"))
def stat_count_compat(spark, d):
    return triggers.stat_count(a.event_orders(spark, d), HOUR, 2, compat=True)


QUARTER = HOUR // 4
DAY_START = f"ct - (ct + {8 * HOUR}) % {DAY}"


@query("stat_time", a.with_sql(f"""SELECT a.traffic, a."etTime", a."startWindowTime", a."ptTime", count(*) AS orders, count(DISTINCT b."userID") AS users, CAST(sum(b.fee) AS BIGINT) AS "totalFee" FROM
  (SELECT DISTINCT traffic, {HOUR_SQL} AS "etTime", {DAY_START} AS "startWindowTime", {_start(QUARTER)} + {QUARTER} AS "ptTime" FROM event_orders) a
  JOIN (SELECT *, {HOUR_SQL} AS "etTime", {DAY_START} AS "startWindowTime" FROM event_orders) b
  ON a.traffic = b.traffic AND a."etTime" = b."etTime" AND a."startWindowTime" = b."startWindowTime" AND b.ct < a."ptTime" GROUP BY 1, 2, 3, 4""", "event_orders"))
def stat_time(spark, d):
    return triggers.stat_time(a.event_orders(spark, d), QUARTER)


SIX = 6 * HOUR


@query("stat_count_or_time", a.with_sql(f"""SELECT "productType", "toursimType", min(ct) AS "startWindowTime", CASE WHEN count(*) >= 5 THEN max(ct) ELSE s + {SIX} END AS "endWindowTime",
  count(*) AS orders, count(DISTINCT "userID") AS users, CAST(sum(fee) AS BIGINT) AS "totalFee", CASE WHEN count(*) >= 5 THEN 'count' ELSE 'timer' END AS trigger FROM (
    SELECT *, (row_number() OVER (PARTITION BY "productType", "toursimType", s ORDER BY ct, "orderID") - 1) // 5 AS b FROM (SELECT *, {_start(SIX)} AS s FROM wide)) GROUP BY "productType", "toursimType", s, b""", "event_orders", "products", "wide"))
def stat_count_or_time(spark, d):
    return triggers.stat_count_or_time(enrich.join_product_left(a.event_orders(spark, d), a.products(spark, d)), SIX, 5)


@query("acc_depcode", a.with_sql('SELECT "depCode", count(*) AS orders, CAST(sum(fee) AS BIGINT) AS fee, max(ct) AS ct FROM wide GROUP BY 1', "event_orders", "products", "wide"))
def acc_depcode(spark, d):
    return windows.departures(enrich.join_product_left(a.event_orders(spark, d), a.products(spark, d)))


@query("distinct_users", a.with_sql('SELECT traffic, "userRegion", count(DISTINCT "userID") AS users FROM star_orders GROUP BY 1, 2', "star_orders"))
def distinct_users(spark, d):
    return windows.distinct_users(a.star_orders(spark, d), ["traffic", "userRegion"])


def _bounds(ms: int) -> str:
    return f'{_start(ms)} AS "startWindowTime", {_start(ms)} + {ms} AS "endWindowTime"'


@query("launch_stats", a.with_sql(f'SELECT "userRegion", {_bounds(DAY)}, count(*) AS access, count(DISTINCT "userID") AS users FROM event_logs GROUP BY 1, 2, 3', "event_logs"))
def launch_stats(spark, d):
    return windows.launch_stats(a.event_logs(spark, d), "1 day")


@query("page_view_stats", a.with_sql(f'SELECT "targetID", {_bounds(DAY)}, count(*) AS access, count(DISTINCT "userID") AS users, CAST(sum(seconds) AS BIGINT) AS "totalDuration", CAST(sum(seconds) // count(*) AS DOUBLE) AS "avgDuration", max(ct) AS "maxTimestamp" FROM event_logs WHERE {VIEWS} GROUP BY 1, 2, 3', "event_logs"))
def page_view_stats(spark, d):
    views = a.event_logs(spark, d)
    return windows.page_view_stats(logs.page_views(views).withColumn("targetID", F.get_json_object("exts", "$.targetID")), "1 day")


@query("low_durations", a.with_sql(f"SELECT sid, duration FROM event_logs WHERE {VIEWS} AND seconds < 5", "event_logs"))
def low_durations(spark, d):
    return windows.low_durations(logs.page_views(a.event_logs(spark, d))).select("sid", "duration")


@query("click_stats_window", a.with_sql(f'SELECT "userRegion", "eventTargetType", {_bounds(DAY)}, count(*) AS clicks FROM event_logs WHERE {CLICKS} GROUP BY 1, 2, 3, 4', "event_logs"))
def click_stats_window(spark, d):
    clicks = logs.clicks(a.event_logs(spark, d)).withColumn("eventTargetType", F.get_json_object("exts", "$.eventTargetType"))
    return windows.click_stats(clicks, "1 day")


@query("click_stats_type", a.with_sql(f'SELECT "eventTargetType", count(*) AS clicks FROM event_logs WHERE {CLICKS} GROUP BY 1', "event_logs"))
def click_stats_type(spark, d):
    return windows.click_stats(logs.click_exts(logs.clicks(a.event_logs(spark, d))), None)


@query("traffic_stats", a.with_sql(f'SELECT traffic, {_bounds(DAY)}, count(*) AS orders, count(DISTINCT "userID") AS users, CAST(sum(fee) AS BIGINT) AS "totalFee" FROM event_orders GROUP BY 1, 2, 3', "event_orders"))
def traffic_stats(spark, d):
    return windows.traffic_stats(a.event_orders(spark, d), "1 day")


# Ranks and runs

LEVEL1 = f"""level1 AS (SELECT "productID", traffic, {_start(DAY)} AS "startWindowTime", {_start(DAY)} + {DAY} AS "endWindowTime", {TOTALS}, {_start(DAY)} - ({_start(DAY)}) % {3 * DAY} AS window2 FROM event_orders GROUP BY ALL)"""


@query("topn_per_key", a.with_sql(f"""SELECT * FROM (WITH {LEVEL1} SELECT window2, "productID", traffic, "startWindowTime", "endWindowTime", orders, "totalFee", row_number() OVER (PARTITION BY window2, "productID", traffic ORDER BY orders DESC, "totalFee" DESC) AS rank FROM (
  SELECT window2, "productID", traffic, min("startWindowTime") AS "startWindowTime", min("endWindowTime") AS "endWindowTime", orders, "totalFee" FROM level1 GROUP BY window2, "productID", traffic, orders, "totalFee")) WHERE rank <= 2""", "event_orders"))
def topn_per_key(spark, d):
    return ranking.top_per_key(windows.product_traffic(a.event_orders(spark, d), "1 day"), 3 * DAY, 2)


@query("topn_per_window", a.with_sql(f"""SELECT * FROM (WITH {LEVEL1} SELECT window2, "productID", traffic, "startWindowTime", "endWindowTime", orders, "totalFee", row_number() OVER (PARTITION BY window2 ORDER BY orders DESC, "totalFee" DESC, "productID", traffic, "startWindowTime") AS rank FROM level1) WHERE rank <= 30""", "event_orders"))
def topn_per_window(spark, d):
    return ranking.top_per_window(windows.product_traffic(a.event_orders(spark, d), "1 day"), 3 * DAY, 30)


def _bad_sql(key: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"""ranked AS (SELECT *, row_number() OVER ({part}ORDER BY ct, sid) AS pos, sum(CASE WHEN seconds < 5 OR seconds > 50 THEN 0 ELSE 1 END) OVER ({part}ORDER BY ct, sid ROWS UNBOUNDED PRECEDING) AS island FROM event_logs WHERE {VIEWS}),
bad AS (SELECT * FROM ranked WHERE seconds < 5 OR seconds > 50)"""


def _matches_sql(key: str, ms: int) -> str:
    on = f"s.{key} = e.{key} AND" if key else ""
    return f"""(WITH {_bad_sql(key)} SELECT {f's.{key}, ' if key else ''}s.sid AS "startId", e.sid AS "endId", s.ct AS "startCt", e.ct AS "endCt", e.pos - s.pos + 1 AS events, s.pos AS p, e.pos AS q
FROM bad s JOIN bad e ON {on} s.island = e.island AND e.pos > s.pos AND e.ct - s.ct < {ms})"""


def _alerts_sql(key: str, ms: int) -> str:
    on = f"l.{key} = e.{key} AND" if key else ""
    return f"""(WITH {_bad_sql(key)} SELECT DISTINCT l."userDevice", l."userID", l."userRegion", l."userRegionIP", l.duration, l.ct, l.sid
FROM bad l JOIN bad e ON {on} l.island = e.island AND abs(e.pos - l.pos) = 1 AND abs(e.ct - l.ct) < {ms})"""


@query("cep_alerts", a.with_sql(f"SELECT * FROM {_alerts_sql('"userID"', DAY)}", "event_logs"))
def cep_alerts(spark, d):
    return cep.alerts(logs.page_views(a.event_logs(spark, d)), within_ms=DAY)


@query("cep_alerts_unkeyed", a.with_sql(f"SELECT * FROM {_alerts_sql('', HOUR)}", "event_logs"))
def cep_alerts_unkeyed(spark, d):
    return cep.alerts(logs.page_views(a.event_logs(spark, d)), within_ms=HOUR, keys=[])


@query("cep_matches", a.with_sql(f'SELECT "userID", "startId", "endId", "startCt", "endCt", events FROM {_matches_sql('"userID"', DAY)}', "event_logs"))
def cep_matches(spark, d):
    return cep.matches(logs.page_views(a.event_logs(spark, d)), within_ms=DAY)


@query("cep_matches_unkeyed", a.with_sql(f'SELECT "startId", "endId", "startCt", "endCt", events FROM {_matches_sql('', HOUR)}', "event_logs"))
def cep_matches_unkeyed(spark, d):
    return cep.matches(logs.page_views(a.event_logs(spark, d)), within_ms=HOUR, keys=[])


# Sinks: the frames that are written


@query("snk_kafka", a.with_sql(f"""SELECT md5("userID" || "userRegion" || "userRegionIP") AS key, '{{"userDevice":"' || "userDevice" || '","userID":"' || "userID" || '","userRegion":"' || "userRegion" || '","userRegionIP":"' || "userRegionIP" || '","duration":"' || duration || '","ct":"' || ct || '"}}' AS value
FROM {_alerts_sql('"userID"', DAY)}""", "event_logs"))
def snk_kafka(spark, d):
    return sinks.messages(cep.alerts(logs.page_views(a.event_logs(spark, d)), within_ms=DAY).drop("sid"), "page_view_alert")


@query("snk_upsert", a.with_sql("""SELECT id, "orderID", fee, ct FROM (SELECT "userID" || '_' || "productID" AS id, "orderID", CAST(fee AS BIGINT) AS fee, ct, row_number() OVER (PARTITION BY "userID", "productID" ORDER BY ct DESC, "orderID" DESC) AS n FROM event_orders) WHERE n = 1""", "event_orders"))
def snk_upsert(spark, d):
    o = a.event_orders(spark, d).select(key_concat("userID", "productID").alias("id"), "orderID", F.col("fee").cast("long").alias("fee"), "ct")
    first = F.col("ct") % 2 == 0
    return sinks.upserted(sinks.latest(o.where(first), "id", ["ct", "orderID"]), o.where(~first), "id", ["ct", "orderID"])


@query("snk_upsert_sid", a.with_sql(f'SELECT sid, "userID", "targetID", ct FROM event_logs WHERE {CLICKS}', "event_logs"))
def snk_upsert_sid(spark, d):
    """The table holds an older version of half of the clicks; all clicks then come in."""
    c = logs.click_exts(logs.clicks(a.event_logs(spark, d))).select("sid", "userID", "targetID", "ct")
    older = c.where(F.xxhash64("sid") > 0).withColumns({"targetID": F.lit("older"), "ct": F.col("ct") - 1})
    return sinks.upserted(older, c, "sid", ["ct"])


@query("snk_accumulate", a.with_sql("SELECT \"depCode\", count(*) AS orders, CAST(sum(fee) AS BIGINT) AS fee, strftime(epoch_ms(max(ct)), '%Y-%m-%dT%H:%M:%S') || '+0000' AS ct FROM wide GROUP BY 1", "event_orders", "products", "wide"))
def snk_accumulate(spark, d):
    """Totals of one half of the orders are stored, and those of the other are added."""
    wide = enrich.join_product_left(a.event_orders(spark, d), a.products(spark, d))
    stored = F.xxhash64("orderID") > 0
    return windows.accumulated(windows.departures(wide.where(stored)), windows.departures(wide.where(~stored))).withColumn("ct", fmt_iso("ct"))


@query("snk_kv", a.with_sql(f"""SELECT key, '{{"userRegion":"' || "userRegion" || '","traffic":"' || traffic || '","startWindowTime":"' || "startWindowTime" || '","orders":"' || orders || '"}}' AS value FROM (
  SELECT "userRegion" || '_' || traffic AS key, "userRegion", traffic, {_start(HOUR)} AS "startWindowTime", count(*) AS orders, row_number() OVER (PARTITION BY "userRegion", traffic ORDER BY {_start(HOUR)} DESC) AS n
  FROM event_orders GROUP BY "userRegion", traffic, {_start(HOUR)}) WHERE n = 1""", "event_orders"))
def snk_kv(spark, d):
    out = windows.region_traffic(a.event_orders(spark, d), "1 hour").select("userRegion", "traffic", "startWindowTime", "orders")
    return sinks.key_values(out, "userRegion", "traffic")


@query("snk_parquet_hourly", a.with_sql(f"SELECT {ORDERS}, {HOUR_SQL} AS dt_hour FROM event_orders", "event_orders"))
def snk_parquet_hourly(spark, d):
    return sinks.landing(a.event_orders(spark, d).select(*ORDER_DETAIL.names))


# Streams over the whole table, run to the end. What a watermark has not passed stays in state.

CLOSED = "(SELECT max(ct) - 15000 FROM event_orders)"


@query("stream_region_traffic", a.with_sql(f"""SELECT "userRegion", traffic, {_start(HOUR)} AS "startWindowTime", {_start(HOUR)} + {HOUR} AS "endWindowTime", {M4} FROM event_orders
WHERE {_start(HOUR)} + {HOUR} <= {CLOSED} GROUP BY 1, 2, 3, 4""", "event_orders"))
def stream_region_traffic(spark, d):
    return live.finished(windows.region_traffic(a.event_orders(spark, d, stream=True), "1 hour"))


@query("stream_count_windows", a.with_sql(_count_sql('"userRegion", traffic', 10).replace("source", "event_orders"), "event_orders"))
def stream_count_windows(spark, d):
    return live.finished(stateful.count_windows(a.event_orders(spark, d, stream=True), ["userRegion", "traffic"], 10))


@query("stream_topn_per_window", a.with_sql(f"""SELECT * FROM (WITH {LEVEL1} SELECT window2, "productID", traffic, "startWindowTime", "endWindowTime", orders, "totalFee", row_number() OVER (PARTITION BY window2 ORDER BY orders DESC, "totalFee" DESC, "productID", traffic, "startWindowTime") AS rank
FROM level1 WHERE window2 + {3 * DAY} <= {CLOSED}) WHERE rank <= 30""", "event_orders"))
def stream_topn_per_window(spark, d):
    return live.finished(patterns.top_per_window(a.event_orders(spark, d, stream=True), "1 day", 3 * DAY, 30))


@query("stream_accumulate", a.with_sql('SELECT "depCode", count(*) AS orders, CAST(sum(fee) AS BIGINT) AS fee, max(ct) AS ct FROM wide GROUP BY 1', "event_orders", "products", "wide"))
def stream_accumulate(spark, d):
    """Half of the orders are totals in the store when the stream of the others begins."""
    stored, dim = F.xxhash64("orderID") > 0, a.products(spark, d)
    before = windows.departures(enrich.join_product_left(a.event_orders(spark, d).where(stored), dim))
    live_rows = enrich.join_product_left(a.event_orders(spark, d, stream=True).where(~stored), dim)
    shown = live.finished(totals.accumulate(live_rows, before))
    return sinks.latest(shown.unionByName(before), "depCode", ["orders"])


@query("stream_distinct_users", a.with_sql('SELECT "userRegion", traffic, count(DISTINCT "userID") AS users FROM event_orders GROUP BY 1, 2', "event_orders"))
def stream_distinct_users(spark, d):
    shown = live.finished(totals.distinct_users(a.event_orders(spark, d, stream=True), ["userRegion", "traffic"], 4))
    return shown.groupBy("userRegion", "traffic").agg(F.max("users").alias("users"))


@query("stream_product_versions", a.with_sql(f"SELECT * FROM ({VERSIONED}) WHERE ct <= {CLOSED}", "event_orders", "products"))
def stream_product_versions(spark, d):
    """The later versions come as a stream, the others are there at the start."""
    known = a.product_versions(spark, d)
    later = known.where("valid_from > 0")
    path = live.folder(spark)
    later.write.parquet(f"{path}/changes")
    changes = spark.readStream.schema(later.schema).parquet(f"{path}/changes")
    orders = a.event_orders(spark, d, stream=True, watermark=None).drop("event_time")
    wide = versions.join_versions(orders, changes, known.where("valid_from = 0"), salts=2)
    return live.finished(wide.select("orderID", "ct", "productID", "productType", "productLevel", "depCode"))


@query("stream_upsert_twice", a.with_sql("""SELECT id, "orderID", fee, ct FROM (SELECT "userID" || '_' || "productID" AS id, "orderID", CAST(fee AS BIGINT) AS fee, ct, row_number() OVER (PARTITION BY "userID", "productID" ORDER BY ct DESC, "orderID" DESC) AS n FROM event_orders) WHERE n = 1""", "event_orders"))
def stream_upsert_twice(spark, d):
    """An upsert whose query is lost after a batch is written and is then started again, and whose table is folded in between."""
    path = live.folder(spark)
    table = sinks.Upserts(spark, f"{path}/table", "id", ["ct", "orderID"])
    lost = [True]

    def write(rows, batch):
        table.write(rows, batch)
        if lost.pop():
            raise RuntimeError("lost on purpose")

    for _ in range(2):
        rows = a.event_orders(spark, d, stream=True).select(key_concat("userID", "productID").alias("id"), "orderID", F.col("fee").cast("long").alias("fee"), "ct")
        try:
            live.run(rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint"))
        except StreamingQueryException as e:
            if "lost on purpose" not in str(e):
                raise
            lost.append(False)
            table.fold(0)
    return table.read()
