"""Order and log records made from the driver's tables, in Spark and in the same SQL.

``SQL`` holds the common table expressions that give the oracle the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_out
from ..operators.enrich import sized
from ..operators.windows import WATERMARK, with_event_time
from ..schemas import ORDER_WIRE


def _table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A stream takes a single file only by a pattern.
    return spark.readStream.schema(df.schema).parquet(f"{sf_dir}/{name}.parque[t]") if stream else df


def _ms(name: str):
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz)) div 1000")


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


def _k():
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


def event_orders(spark: SparkSession, sf_dir: str, stream: bool = False, watermark: str | None = WATERMARK) -> DataFrame:
    """Small orders from ``events``, for windows, triggers and ranks; a stream has its watermark."""
    e = _table(spark, sf_dir, "events", stream).withColumns({"k": _k(), "fee": _cents("value"), "ct": _ms("ts")})
    s = lambda c: F.expr(c).cast("string")
    out = e.select(
        s("event_id").alias("orderID"), s("user_id").alias("userID"), s("k").alias("productID"), s("user_id").alias("pubID"), s("1000 + user_id").alias("userMobile"),
        F.concat(F.lit("R"), s("user_id % 10")).alias("userRegion"), F.col("event_type").alias("traffic"), s("k % 4").alias("trafficGrade"), s("k % 3").alias("trafficType"),
        F.col("fee").cast("int").alias("price"), F.col("fee").cast("int").alias("fee"), s("k % 2").alias("hasActivity"),
        s("k % 3 + 1").alias("adult"), s("k % 2").alias("yonger"), s("k % 5 % 2").alias("baby"), "ct",
    )
    return with_event_time(out, watermark)


def star_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many orders from the star schema, for joins and large group-bys."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = (
        t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
        .join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(sized(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    s = lambda c: F.expr(c).cast("string")
    out = rows.select(
        s("l_orderkey").alias("orderID"), s("o_custkey").alias("userID"), s("l_partkey").alias("productID"), s("l_suppkey").alias("pubID"), s("o_custkey").alias("userMobile"),
        F.col("n_name").alias("userRegion"), F.col("o_orderpriority").alias("traffic"), s("l_linenumber % 3").alias("trafficGrade"), s("l_linenumber % 2").alias("trafficType"),
        _cents("l_extendedprice").cast("int").alias("price"), _cents("l_extendedprice").cast("int").alias("fee"), F.lit("0").alias("hasActivity"),
        s("l_linenumber % 3 + 1").alias("adult"), s("l_linenumber % 2").alias("yonger"), F.lit("0").alias("baby"), _ms("o_orderdate").alias("ct"),
    )
    return with_event_time(out)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_size").cast("int").alias("product_level"), F.col("p_type").alias("product_type"),
        F.concat(F.lit("D"), F.expr("p_partkey % 10").cast("string")).alias("departure_code"), F.concat(F.lit("E"), F.expr("p_partkey % 7").cast("string")).alias("des_city_code"),
        F.col("p_brand").alias("toursim_tickets_type"),
    )


#: From when the later version of product k holds: so many milliseconds a product after a day of the events' month.
LATER, STAGGER = 1_705_000_000_000, 3_600_000


def product_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each product: one from the beginning, and one of another level and departure from a time of its own."""
    one = products(spark, sf_dir)
    later = one.withColumns({"product_level": F.col("product_level") + 100, "departure_code": F.concat(F.lit("L"), "departure_code"), "valid_from": LATER + STAGGER * F.col("product_id").cast("bigint")})
    return one.withColumn("valid_from", F.lit(0).cast("bigint")).unionByName(later)


def pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.expr(c).cast("string")
    return _table(spark, sf_dir, "supplier").select(
        s("s_suppkey").alias("pub_id"), F.col("s_name").alias("pub_name"), s("s_nationkey % 5").alias("pub_star"), s("s_suppkey % 3").alias("pub_grade"), s("s_nationkey < 13").alias("is_national"),
    )


def hotel_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotels as products; events have users beyond them, so orders of a user's own hotel may have no match."""
    s = lambda c: F.expr(c).cast("string")
    return _table(spark, sf_dir, "supplier").select(
        s("s_suppkey").alias("product_id"), F.expr("s_nationkey % 5").cast("int").alias("product_level"), F.col("s_name").alias("product_type"),
        F.concat(F.lit("D"), s("s_suppkey % 10")).alias("departure_code"), F.concat(F.lit("E"), s("s_suppkey % 7")).alias("des_city_code"), F.lit("hotel").alias("toursim_tickets_type"),
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour logs (VIEW_LIST columns) from ``events``; clicks, list views and page views."""
    e = _table(spark, sf_dir, "events").withColumns({"k": _k(), "ct": _ms("ts")})
    kind = F.col("event_type")
    ids = F.concat(F.lit("["), F.expr("array_join(transform(slice(array(1, 2, 3), 1, k % 4), i -> concat('\\\\\"P', k + i, '\\\\\"')), ',')"), F.lit("]"))
    exts = F.concat(F.lit('{"targetID":"P'), F.col("k"), F.lit('","eventTargetType":"0'), F.expr("k % 3"), F.lit('","travelSend":"D'), F.expr("k % 10"), F.lit('","travelTime":'), F.expr("k % 5"), F.lit(',"targetIDS":"'), ids, F.lit('"}'))
    s = lambda c: F.expr(c).cast("string")
    return with_event_time(e.select(
        s("event_id").alias("sid"), s("user_id % 7").alias("userDevice"), F.lit("01").alias("userDeviceType"), F.lit("a").alias("os"), s("user_id").alias("userID"),
        F.concat(F.lit("R"), s("user_id % 10")).alias("userRegion"), F.concat(F.lit("10.0.0."), s("user_id % 10")).alias("userRegionIP"), F.lit("0").alias("lonitude"), F.lit("0").alias("latitude"),
        F.lit("m").alias("manufacturer"), F.lit("c").alias("carrier"), F.lit("n").alias("networkType"), s("cast(floor(value) as bigint)").alias("duration"), exts.alias("exts"),
        F.when(kind == "view", "08").when(kind == "purchase", "07").otherwise("05").alias("action"),
        F.when(kind == "click", "02").when(kind == "signup", "04").otherwise("01").alias("eventType"), "ct", s("k % 2").alias("hotTarget"),
    ))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order JSON in ``value``, with some malformed numbers."""
    o = event_orders(spark, sf_dir)
    wire = [F.col(c).cast("string").alias(k) for k, c in ORDER_WIRE.items() if c != "fee"]
    fee = F.when(F.col("ct") % 50 == 0, F.lit("x")).otherwise(F.col("fee").cast("string")).alias("product_fee")
    return o.select(F.to_json(F.struct(*wire, fee)).alias("value"))


def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = event_logs(spark, sf_dir).drop("event_time")
    return logs.select(json_out(logs).alias("value"))


def _k_sql() -> str:
    return "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"


SQL = {
    "event_orders": f"""event_orders AS (
  SELECT CAST(event_id AS VARCHAR) AS "orderID", CAST(user_id AS VARCHAR) AS "userID", CAST(k AS VARCHAR) AS "productID",
    CAST(user_id AS VARCHAR) AS "pubID", CAST(1000 + user_id AS VARCHAR) AS "userMobile", 'R' || (user_id % 10) AS "userRegion", event_type AS traffic,
    CAST(k % 4 AS VARCHAR) AS "trafficGrade", CAST(k % 3 AS VARCHAR) AS "trafficType", CAST(fee AS INTEGER) AS price, CAST(fee AS INTEGER) AS fee,
    CAST(k % 2 AS VARCHAR) AS "hasActivity", CAST(k % 3 + 1 AS VARCHAR) AS adult, CAST(k % 2 AS VARCHAR) AS yonger, CAST(k % 5 % 2 AS VARCHAR) AS baby,
    k % 3 + 1 + k % 2 + k % 5 % 2 AS members, ct
  FROM (SELECT *, {_k_sql()} AS k, CAST(round(value * 100) AS BIGINT) AS fee, epoch_us(ts) // 1000 AS ct FROM events))""",
    "star_orders": """star_orders AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS "orderID", CAST(o_custkey AS VARCHAR) AS "userID", CAST(l_partkey AS VARCHAR) AS "productID",
    CAST(l_suppkey AS VARCHAR) AS "pubID", n_name AS "userRegion", o_orderpriority AS traffic, CAST(round(l_extendedprice * 100) AS BIGINT) AS fee,
    l_linenumber % 3 + 1 + l_linenumber % 2 AS members, epoch_us(o_orderdate) // 1000 AS ct
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "products": """products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_size AS INTEGER) AS product_level, p_type AS product_type, 'D' || (p_partkey % 10) AS departure_code,
    'E' || (p_partkey % 7) AS des_city_code, p_brand AS toursim_tickets_type FROM part)""",
    "pubs": """pubs AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS pub_id, s_name AS pub_name, CAST(s_nationkey % 5 AS VARCHAR) AS pub_star, CAST(s_suppkey % 3 AS VARCHAR) AS pub_grade,
    CASE WHEN s_nationkey < 13 THEN 'true' ELSE 'false' END AS is_national FROM supplier)""",
    "event_logs": f"""event_logs AS (
  SELECT CAST(event_id AS VARCHAR) AS sid, CAST(user_id % 7 AS VARCHAR) AS "userDevice", CAST(user_id AS VARCHAR) AS "userID", 'R' || (user_id % 10) AS "userRegion",
    '10.0.0.' || (user_id % 10) AS "userRegionIP", CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS duration, CAST(floor(value) AS BIGINT) AS seconds, k, 'P' || k AS "targetID", '0' || (k % 3) AS "eventTargetType",
    CASE event_type WHEN 'view' THEN '08' WHEN 'purchase' THEN '07' ELSE '05' END AS action,
    CASE event_type WHEN 'click' THEN '02' WHEN 'signup' THEN '04' ELSE '01' END AS "eventType", ct, CAST(k % 2 AS VARCHAR) AS "hotTarget"
  FROM (SELECT *, {_k_sql()} AS k, epoch_us(ts) // 1000 AS ct FROM events))""",
    "wide": """wide AS (
  SELECT o.*, CASE WHEN product_id IS NULL THEN -1 ELSE product_level END AS "productLevel", CASE WHEN product_id IS NULL THEN '-1' ELSE product_type END AS "productType",
    CASE WHEN product_id IS NULL THEN '-1' ELSE toursim_tickets_type END AS "toursimType", CASE WHEN product_id IS NULL THEN '-1' ELSE departure_code END AS "depCode",
    CASE WHEN product_id IS NULL THEN '-1' ELSE des_city_code END AS "desCode"
  FROM {orders} o LEFT JOIN products ON "productID" = product_id)""",
}


def with_sql(body: str, *parts: str, orders: str = "event_orders") -> str:
    """``body`` after the named table expressions."""
    return "WITH " + ",\n".join(SQL[p].replace("{orders}", orders) for p in parts) + "\n" + body
