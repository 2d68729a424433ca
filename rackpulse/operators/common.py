"""Inputs most reports start from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.dates import day_key, month_of_day_key, ts_bound
from rackpulse.sources.catalog import PAID, Catalog, paid, snapshot


def paid_orders(cat: Catalog, as_of: str, status: int = PAID, since: str | None = None,
                since_inclusive: bool = False, until: str | None = None) -> DataFrame:
    """Paid orders of snapshot ``as_of``; optional pay-time bounds (``since`` strict by default, as
    in ``pay_complete_time > '...'``; ``until`` exclusive). Bounds are literals of the column type, so
    they reach the scan as pushed filters."""
    o = paid(snapshot(cat.table("rack_order"), as_of), status)
    return _time_bounds(o, since, since_inclusive, until)


def paid_items(cat: Catalog, as_of: str, status: int = PAID, since: str | None = None,
               since_inclusive: bool = False, until: str | None = None) -> DataFrame:
    i = paid(snapshot(cat.table("order_item"), as_of), status)
    return _time_bounds(i, since, since_inclusive, until)


def _time_bounds(df: DataFrame, since, since_inclusive, until) -> DataFrame:
    t = "pay_complete_time"
    if since is not None:
        b = ts_bound(df, t, since)
        df = df.where(F.col(t) >= b if since_inclusive else F.col(t) > b)
    if until is not None:
        df = df.where(F.col(t) < ts_bound(df, t, until))
    return df


def with_keys(df: DataFrame, month_fmt: str | None = None) -> DataFrame:
    """Add ``payday`` (yyyyMMdd; facts stored by day have it) and, when ``month_fmt`` is given, ``month``, cut out of the day."""
    if "payday" not in df.columns:
        df = df.withColumn("payday", day_key("pay_complete_time"))
    if month_fmt:
        df = df.withColumn("month", month_of_day_key("payday", month_fmt))
    return df


def racks_at(cat: Catalog, as_of: str) -> DataFrame:
    return snapshot(cat.table("rack"), as_of)


def on_days(df: DataFrame, days, column: str = "pay_complete_time") -> DataFrame:
    """Rows whose timestamp falls on one of ``days`` (``yyyyMMdd``): an OR of day ranges on the raw
    timestamp, which the parquet reader can push down (a formatted-string filter could not)."""
    cond = None
    for d in days:
        start = dt.date(int(d[0:4]), int(d[4:6]), int(d[6:8]))
        lo = ts_bound(df, column, f"{start} 00:00:00")
        hi = ts_bound(df, column, f"{start + dt.timedelta(days=1)} 00:00:00")
        c = (F.col(column) >= lo) & (F.col(column) < hi)
        cond = c if cond is None else cond | c
    return df.where(cond)


def first_per_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row per ``key`` by ``order`` (ties broken by the later ``order`` columns).

    A ``min`` over a struct instead of ``row_number() = 1``: the aggregate combines map-side, so a key
    holding a large share of the rows sends one row per task to the shuffle instead of all of them
    to one sorting task.
    """
    fields = list(dict.fromkeys(order + keep))
    first = df.groupBy(key).agg(F.min(F.struct(*fields)).alias("_first"))
    return first.select(key, *[F.col(f"_first.{c}").alias(c) for c in fields])
