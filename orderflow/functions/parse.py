"""Wire JSON to typed columns; rows that cannot be read go to a side frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ORDER_DETAIL, ORDER_NUMBERS, ORDER_WIDE, ORDER_WIRE, USER_LOG, VIEW_LIST

REASON = "reject_reason"


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _read(df: DataFrame, value: str, names, *kept) -> DataFrame:
    """One string column for each name, and the columns of ``kept``.

    A generator holds the parsed record, so filters and projections above it use its
    columns: each message is parsed once, whatever is asked of it.
    """
    return df.select(*kept, F.inline(F.array(F.from_json(value, _strings(names)))))


def _orders(df: DataFrame, value: str, wire: dict[str, str], numbers: dict[str, str], schema: T.StructType) -> DataFrame:
    read = _read(df, value, wire, F.col(value).alias("value"))
    columns = {}
    for key, name in wire.items():
        columns[name] = F.col(key).try_cast(numbers[name]) if name in numbers else F.coalesce(key, F.lit(""))
    bad = [F.when(columns[n].isNull(), F.lit(n)) for n in numbers]
    reason = F.nullif(F.concat_ws(",", *bad), F.lit(""))
    return read.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in schema.fields), reason.alias(REASON), "value")


def parse_orders(df: DataFrame, value: str = "value") -> DataFrame:
    """ORDER_DETAIL, ``reject_reason`` (null if the row is good) and the raw value.

    A missing string is empty; price, fee and ct must be numbers.
    """
    return _orders(df, value, ORDER_WIRE, ORDER_NUMBERS, ORDER_DETAIL)


def parse_wide(df: DataFrame, value: str = "value") -> DataFrame:
    """ORDER_WIDE from its own JSON (keys are the column names)."""
    wire = {f.name: f.name for f in ORDER_WIDE.fields}
    return _orders(df, value, wire, ORDER_NUMBERS | {"productLevel": "int"}, ORDER_WIDE)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REASON).isNull()).drop(REASON, "value")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REASON).isNotNull()).select("value", REASON)


def parse(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Any record bound by field name; longs may be written as strings."""
    numbers = (T.LongType, T.IntegerType, T.DoubleType)
    get = lambda f: F.col(f.name).try_cast(f.dataType) if isinstance(f.dataType, numbers) else F.col(f.name)
    return _read(df, value, schema.names).select(*(get(f).alias(f.name) for f in schema.fields))


def parse_logs(df: DataFrame, value: str = "value") -> DataFrame:
    return parse(df, USER_LOG, value)


def parse_view_list(df: DataFrame, value: str = "value") -> DataFrame:
    return parse(df, VIEW_LIST, value)


__all__ = ["REASON", "accepted", "parse", "parse_logs", "parse_orders", "parse_view_list", "parse_wide", "rejected"]
