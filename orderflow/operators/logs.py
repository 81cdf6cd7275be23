"""Behaviour logs: filters, extension fields, list explosion and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTIONS, CLICK, EVENTS, LIST_EVENTS, LIST_EXTS, PAGE_ACTIONS, PAGE_VIEW, VIEW_LIST_FACT

REASON = "reject_reason"


def _is(name: str, *codes: str):
    return F.lower(name).isin([c.lower() for c in codes])


def clicks(df: DataFrame) -> DataFrame:
    return df.where(_is("action", ACTIONS["interactive"]) & _is("eventType", EVENTS["click"]))


def page_views(df: DataFrame) -> DataFrame:
    return df.where(_is("action", *PAGE_ACTIONS))


def list_views(df: DataFrame) -> DataFrame:
    return df.where(_is("action", ACTIONS["interactive"]) & _is("eventType", *LIST_EVENTS))


def _ext(key: str):
    return F.coalesce(F.get_json_object("exts", f"$.{key}"), F.lit("")).alias(key)


def click_exts(df: DataFrame) -> DataFrame:
    """CLICK: targetID and eventTargetType from ``exts``, empty where missing."""
    return df.withColumns({"targetID": _ext("targetID"), "eventTargetType": _ext("eventTargetType")}).select(*CLICK.names)


def page_view_exts(df: DataFrame) -> DataFrame:
    return df.withColumn("targetID", _ext("targetID")).select(*PAGE_VIEW.names)


def explode_view_list(df: DataFrame) -> DataFrame:
    """VIEW_LIST_FACT: one row for each id in ``exts.targetIDS``; no ids, no rows.

    The list is JSON in a string, or a plain JSON list. Numbers keep their source text.
    """
    ids = F.from_json(F.get_json_object("exts", "$.targetIDS"), "array<string>")
    df = df.withColumns({k: _ext(k) for k in LIST_EXTS})
    return df.withColumn("targetID", F.explode(ids)).select(*VIEW_LIST_FACT.names)


def _marked(df: DataFrame, **tests) -> DataFrame:
    return df.withColumn(REASON, F.nullif(F.concat_ws(",", *(F.when(t, F.lit(n)) for n, t in tests.items())), F.lit("")))


def check_logs(df: DataFrame) -> DataFrame:
    """``reject_reason``: which of action, eventType and ct are null."""
    return _marked(df, **{c: F.col(c).isNull() for c in ("action", "eventType", "ct")})


def check_orders(df: DataFrame) -> DataFrame:
    return _marked(df, productID=F.col("productID").isNull(), ct=F.coalesce(F.col("ct"), F.lit(0)) == 0)


def check_documents(df: DataFrame, key: str = "orderID") -> DataFrame:
    return _marked(df, **{key: F.coalesce(F.col(key), F.lit("")) == ""})


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNull()).drop(REASON)


def invalid(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNotNull())


def abnormal(low: int, high: int):
    """Duration outside [low, high]; a duration that is no number is not abnormal."""
    d = F.expr("try_cast(duration as bigint)")
    return F.coalesce((d < low) | (d > high), F.lit(False))
