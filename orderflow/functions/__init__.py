"""Column functions: formats, keys and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO = "yyyy-MM-dd'T'HH:mm:ssZ"


def event_time(ct="ct") -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(F.col(ct) if isinstance(ct, str) else ct)


def fmt_hour(ct) -> Column:
    """``yyyyMMddHH`` in the session's time zone."""
    return F.date_format(event_time(ct), "yyyyMMddHH")


def fmt_iso(ct) -> Column:
    return F.date_format(event_time(ct), ISO)


def fmt_pattern(ct: str, pattern: str) -> Column:
    """Null when the time is not positive."""
    return F.when(F.col(ct) > 0, F.date_format(event_time(ct), pattern))


def key_md5(*names: str) -> Column:
    """md5 of the fields' concatenation; a null field counts as empty."""
    return F.md5(F.concat(*(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)).cast("binary"))


def key_concat(*names: str) -> Column:
    return F.concat_ws("_", *names)


def key_sanitize(name: str) -> Column:
    return F.regexp_replace(name, r"\.", "_")


def key_hash(key: str) -> Column:
    """The key's 32-bit hash, h = 31 h + unit over its UTF-16 units, without its sign.

    A character beyond U+FFFF is two units.
    """
    letters = F.filter(F.split(key, ""), lambda c: c != "")
    code = F.transform(letters, lambda c: F.ascii(c).cast("long"))
    more = lambda a, unit: (a * 31 + unit) % (1 << 32)
    two = lambda a, c: more(more(a, F.shiftright(c - 0x10000, 10) + 0xD800), (c - 0x10000) % 1024 + 0xDC00)
    h = F.aggregate(code, F.lit(0).cast("long"), lambda a, c: F.when(c > 0xFFFF, two(a, c)).otherwise(more(a, c)))
    return F.when(h > 1 << 31, (1 << 32) - h).otherwise(h)


def key_partition(key: str, value: str, partitions: int) -> Column:
    """The partition of a message; null values go to the last."""
    return F.when(F.col(value).isNull(), F.lit(partitions - 1)).otherwise(key_hash(key) % partitions).cast("long")


def json_out(df: DataFrame) -> Column:
    """A row as JSON; longs as strings, nulls kept."""
    fields = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.LongType) else F.col(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def div(a: Column, b: Column) -> Column:
    """Whole-number division as a double."""
    return F.call_function("div", a, b).cast("double")
