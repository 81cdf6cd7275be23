"""Enrichment of orders from the product and hotel dimensions.

Dimensions are reduced to one row for each key. They are broadcast only if Spark's own
estimate of their bytes is under a bound; beyond it, or where Spark can't tell (a JDBC
table that isn't cached), the join shuffles, and AQE splits hot keys or still broadcasts
what turns out small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import PRODUCT_COLUMNS, PUB_COLUMNS

#: The time in ms from which a version of a dimension row holds.
VALID_FROM = "valid_from"
#: Estimated bytes up to which a dimension is broadcast.
BROADCAST_BYTES = 64 << 20


def dedup(dim: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row for each key: the last by ``latest``, else the greatest by all columns. Null keys match nothing and go.

    The greatest struct is summed before the shuffle, so a key with many versions is no burden.
    """
    rest = [c for c in dim.columns if c != key]
    order = [F.col(latest).alias("_latest")] if latest else []
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return dim.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *(F.col("_last")[c].alias(c) for c in rest)).select(*dim.columns)


def sized(dim: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a dimension for broadcast if Spark estimates no more bytes than that; runs no job."""
    estimate = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if estimate <= most else dim


def _product(dim: DataFrame, latest: str | None) -> DataFrame:
    one = dedup(dim, "product_id", latest)
    return sized(one.select(F.col("product_id").alias("_product"), *(F.col(c).alias(n) for n, c in PRODUCT_COLUMNS.items())))


def _pub(dim: DataFrame, latest: str | None) -> DataFrame:
    one = dedup(dim, "pub_id", latest)
    return sized(one.select(F.col("pub_id").alias("_pub"), *(F.col(c).alias(n) for n, c in PUB_COLUMNS.items())))


def _filled(df: DataFrame, names, level, text: str, matched: str) -> DataFrame:
    missing = F.col(matched).isNull()
    fill = {n: F.when(missing, F.lit(level).cast("int") if n == "productLevel" else F.lit(text)).otherwise(F.col(n)) for n in names}
    return df.withColumns(fill).drop(matched)


def join_product_left(orders: DataFrame, products: DataFrame, latest: str | None = None) -> DataFrame:
    """ORDER_WIDE; without a match level -1 and "-1"."""
    joined = orders.withColumn("fee", F.col("fee").cast("long")).join(_product(products, latest), F.col("productID") == F.col("_product"), "left")
    return _filled(joined, PRODUCT_COLUMNS, -1, "-1", "_product")


def join_product_inner(orders: DataFrame, products: DataFrame, latest: str | None = None) -> DataFrame:
    joined = orders.withColumn("fee", F.col("fee").cast("long")).join(_product(products, latest), F.col("productID") == F.col("_product"))
    return joined.drop("_product")


def unmatched_products(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The orders that the inner join leaves out."""
    return orders.join(_product(products, None), F.col("productID") == F.col("_product"), "left_anti")


def join_product_pub(orders: DataFrame, products: DataFrame, pubs: DataFrame, latest: str | None = None) -> DataFrame:
    """ORDER_MWIDE; each side on its own: without a match level 0 and empty strings."""
    orders = orders.withColumn("fee", F.col("fee").cast("long"))
    joined = orders.join(_product(products, latest), F.col("productID") == F.col("_product"), "left")
    joined = _filled(joined, PRODUCT_COLUMNS, 0, "", "_product")
    joined = joined.join(_pub(pubs, latest), F.col("pubID") == F.col("_pub"), "left")
    return _filled(joined, PUB_COLUMNS, 0, "", "_pub")


def product_json() -> Column:
    """A product's columns under the names that orders have; the greater JSON stands where two versions have one time."""
    return F.to_json(F.struct(*(F.col(c).alias(n) for n, c in PRODUCT_COLUMNS.items())), {"ignoreNullFields": "false"})


def version_spans(versions: DataFrame) -> DataFrame:
    """One row for each product and time from which a version of it holds, with the time of the next one."""
    columns = [F.col(c).alias(n) for n, c in PRODUCT_COLUMNS.items()]
    one = versions.where("product_id is not null and valid_from is not null").withColumn(VALID_FROM, F.col(VALID_FROM).cast("long"))
    one = one.groupBy("product_id", VALID_FROM).agg(F.max(F.struct(product_json().alias("_json"), *columns)).alias("v"))
    until = F.lead(VALID_FROM).over(W.partitionBy("product_id").orderBy(VALID_FROM))
    return one.select(F.col("product_id").alias("_product"), F.col(VALID_FROM).alias("_from"), until.alias("_until"), "v.*")


def join_product_versions(orders: DataFrame, versions: DataFrame) -> DataFrame:
    """ORDER_WIDE with the version of each product that held at the order's time: level -1 and "-1" before all versions.

    ``versions`` are rows of the product dimension with ``valid_from``. Each holds until the
    next one, so an order meets one row of its product's at most.
    """
    spans = sized(version_spans(versions).drop("_json"))
    held = (F.col("productID") == F.col("_product")) & (F.col("ct") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("ct") < F.col("_until")))
    joined = orders.withColumn("fee", F.col("fee").cast("long")).join(spans, held, "left")
    return _filled(joined.drop("_from", "_until"), PRODUCT_COLUMNS, -1, "-1", "_product")
