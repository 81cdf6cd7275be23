"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z, lower-cased without touching any other letter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda variable holds it, so the optimizer cannot inline the expression
    at each place of use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors.

    The files are removed when the driver ends, since the frame may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two or three numbers that may be broadcast: a few MB.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df``, written out and marked for broadcast if it has no more than FEW rows; else the join shuffles."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= FEW else df


#: Bits of a filter of keys, in rows of 4 KB: 2 MB at most.
FILTER_BITS = 1 << 24


def may_be_in(df: DataFrame, value: Column, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with ``name``: false only where ``value`` is surely none of the ``key`` values of ``keys``.

    A bit map of hashes, at most FILTER_BITS / 8 bytes however many keys there are, is
    broadcast; so rows with wide columns that a join would drop need no shuffle. The
    more keys there are, the more other rows pass; the join that follows is exact.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    map_, row, place = fresh(df, "map"), fresh(df, "row"), fresh(df, "place")
    maps = keys.select(bit(key).alias("b")).groupBy(F.floor(F.col("b") / 32768).alias(row)).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias(map_))
    at = F.col(place) % 32768
    byte = F.conv(F.hex(F.substring(F.col(map_), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = df.withColumn(place, bit(value)).withColumn(row, F.floor(F.col(place) / 32768)).join(F.broadcast(saved(maps)), row, "left")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return out.withColumn(name, found).select(*(f"`{c}`" for c in df.columns), name)
