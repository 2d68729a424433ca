"""Rack dimension reports: rack list, cities, online racks per snapshot day, grades, online days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.agg import distinct_count
from rackpulse.functions.dates import MONTH_FMT, day_key, month_of_day_key
from rackpulse.functions.ratio import money
from rackpulse.operators.common import paid_orders, racks_at, with_keys
from rackpulse.operators.companies import ACTIVE, LISTED
from rackpulse.sources.catalog import PAID, Catalog, snapshot_in, snapshot_range
from rackpulse.sources.intervals import covered_per_day, days_per_period, valid_on

NO_DATE = "无"  # fixed value: offline date of a rack that is not withdrawn ("none")


def offline_date() -> F.Column:
    """``yyyyMMdd`` of the last update for withdrawn racks that had been online, else ``NO_DATE``."""
    return (F.when((F.col("release_status") == -1) & F.col("online_time").isNotNull(), day_key("update_time"))
            .otherwise(F.lit(NO_DATE)))


RACK_LIST_COLUMNS = ["machine_id", "machine_name", "customer_id", "machine_type_name", "machine_sub_type_name",
                     "address", "online_date", "offline_date", "city_name"]


def rack_list(cat: Catalog, as_of: str, statuses=LISTED, require_city: bool = True) -> DataFrame:
    """Racks with their type, address, online day and offline day."""
    r = racks_at(cat, as_of).where(F.col("release_status").isin(list(statuses)))
    if require_city:
        r = r.where(F.col("city_name").isNotNull())
    return r.select("machine_id", "machine_name", "customer_id", "machine_type_name", "machine_sub_type_name",
                    "address", day_key("online_time").alias("online_date"), offline_date().alias("offline_date"),
                    "city_name")


def city_count(cat: Catalog, as_of: str) -> DataFrame:
    """Number of cities with racks in service."""
    r = racks_at(cat, as_of).where(F.col("release_status").isin(list(ACTIVE)))
    return distinct_count(r, [], "city_name", "city_qyt")


def daily_online_vs_active(cat: Catalog, as_of: str, statuses=ACTIVE, types=(10, 20),
                           status: int = PAID) -> DataFrame:
    """Per day: orders, GMV, selling racks, and racks online in that day's snapshot."""
    r = cat.table("rack").where(F.col("release_status").isin(list(statuses)) & F.col("machine_type").isin(list(types)))
    return _online_vs_active(cat, as_of, distinct_count(r, ["pt"], "machine_id", "online_cnt"), status)


def _online_vs_active(cat: Catalog, as_of: str, online: DataFrame, status: int) -> DataFrame:
    o = with_keys(paid_orders(cat, as_of, status))
    a = o.groupBy("payday", "machine_id").agg(F.count("order_id").alias("n"), F.sum("origin_amount").alias("ori"))
    a = a.groupBy("payday").agg(F.sum("n").alias("order_qyt"), F.sum("ori").alias("ori"),
                                F.count("machine_id").alias("deal_cnt"))
    j = a.join(online, a.payday == online.pt)
    return j.select(F.col("pt").alias("daykey"), "order_qyt", money("ori").alias("ori"), "deal_cnt", "online_cnt")


def grade_counts(cat: Catalog, pts) -> DataFrame:
    """Racks per grade at each of the snapshot days ``pts``."""
    g = snapshot_in(cat.table("rack_grade"), pts)
    return distinct_count(g, ["pt", "machine_grading"], "machine_id", "machine_qyt")


def online_days(cat: Catalog, first: str, last: str, statuses=ACTIVE, month_fmt: str = MONTH_FMT) -> DataFrame:
    """Per month x rack (x name): number of daily snapshots in ``[first, last]`` in which the rack is
    in service."""
    r = snapshot_range(cat.table("rack"), first, last).where(F.col("release_status").isin(list(statuses)))
    return distinct_count(r.withColumn("month", month_of_day_key("pt", month_fmt)),
                          ["month", "machine_id", "machine_name"], "pt", "online_days")


# ---- the same from intervals instead of every day's full table

INTERVAL_COLUMNS = ["machine_id", "machine_name", "machine_type", "release_status"]


def online_days_from(intervals: DataFrame, days: DataFrame, first: str, last: str, statuses=ACTIVE,
                     month_fmt: str = MONTH_FMT) -> DataFrame:
    """``online_days`` from rack intervals (``sources.intervals``, of ``INTERVAL_COLUMNS``) and all snapshot days."""
    r = intervals.where(F.col("release_status").isin(list(statuses)))
    got = days_per_period(r, days, month_of_day_key("pt", month_fmt), ["machine_id", "machine_name"], "online_days",
                          F.col("pt").between(F.lit(str(first)), F.lit(str(last))))
    return got.withColumnRenamed("period", "month")


def daily_online_vs_active_from(cat: Catalog, as_of: str, intervals: DataFrame, days: DataFrame, statuses=ACTIVE, types=(10, 20),
                                status: int = PAID) -> DataFrame:
    """``daily_online_vs_active`` with the online racks counted from intervals."""
    r = intervals.where(F.col("release_status").isin(list(statuses)) & F.col("machine_type").isin(list(types)))
    return _online_vs_active(cat, as_of, covered_per_day(r, days, "online_cnt"), status)


def grade_counts_from(intervals: DataFrame, days: DataFrame, pts) -> DataFrame:
    """``grade_counts`` from intervals of (machine_id, machine_grading)."""
    return distinct_count(valid_on(intervals, days, list(pts)), ["pt", "machine_grading"], "machine_id", "machine_qyt")
