"""Order KPIs per day, week and month; work-day figures; rack-type and period totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.dates import MONTH_FMT, day_start
from rackpulse.functions.ratio import money, ratio
from rackpulse.operators.calendar import WEEK_SUFFIX, workdays_only
from rackpulse.operators.common import on_days, paid_orders, racks_at, with_keys
from rackpulse.sources.catalog import PAID, Catalog

ROUND = 6  # digits kept for averages of non-exact (double) values


def _day_rack(orders: DataFrame, month_fmt: str | None = None) -> DataFrame:
    """Orders rolled up per (day, rack): ``rack_order`` has one row per snapshot and ``order_id`` (a declared
    key, see ``Catalog.duplicate_keys``) and an order has one rack and one pay time, so per-group row
    counts are distinct order counts and sums of them stay exact at coarser grains. Fully map-side
    combinable, even for a hot rack."""
    keys = ["payday", "machine_id"] + (["month"] if month_fmt else [])
    return (with_keys(orders, month_fmt).groupBy(*keys)
            .agg(F.count("order_id").alias("order_qyt"), F.sum("origin_amount").alias("ori"),
                 F.sum("actual_amount").alias("act")))


def daily_kpis(cat: Catalog, as_of: str, since: str, status: int = PAID) -> DataFrame:
    """Per pay day: orders, GMV, selling racks and their companies (orders joined to the racks of the
    same snapshot)."""
    per = _day_rack(paid_orders(cat, as_of, status, since=since))
    racks = racks_at(cat, as_of).select("machine_id", "customer_id")
    j = per.join(racks, "machine_id")
    return (j.groupBy("payday")
            .agg(F.sum("order_qyt").alias("order_qyt"), money(F.sum("ori")).alias("ori"),
                 F.count("machine_id").alias("machine_qyt"),
                 F.countDistinct("customer_id").alias("customer_qyt")))


def rack_type_orders(cat: Catalog, as_of: str, days, sub_type: int = 90, status: int = PAID) -> DataFrame:
    """Orders per day of racks of one sub-type, on the given days."""
    o = on_days(paid_orders(cat, as_of, status), days)
    racks = racks_at(cat, as_of).where(F.col("machine_sub_type") == sub_type).select("machine_id")
    per = _day_rack(o)
    return (per.join(racks, "machine_id").groupBy("payday")
            .agg(F.sum("order_qyt").alias("order_qyt")))


def _per_day(cat: Catalog, as_of: str, status: int, since: str | None = None) -> DataFrame:
    """Per pay day: orders, GMV and selling racks."""
    per = _day_rack(paid_orders(cat, as_of, status, since=since))
    return per.groupBy("payday").agg(F.sum("order_qyt").alias("order_qyt"),
                                     F.sum("ori").alias("ori"), F.sum("act").alias("act"),
                                     F.count("machine_id").alias("machine_qyt"))


def weekly_kpis(cat: Catalog, as_of: str, status: int = PAID) -> DataFrame:
    """Per calendar week (Monday, week label): orders, GMV and average order value."""
    day = _per_day(cat, as_of, status)
    cal = cat.table("calendar").select(
        F.col("day_id").alias("payday"),
        F.date_format("monday_date", "yyyyMMdd").alias("monday_date"),
        F.concat(F.col("year_name_cn"), F.col("week_of_year").cast("string"), F.lit(WEEK_SUFFIX)).alias("week"))
    w = (day.join(cal, "payday").groupBy("monday_date", "week")
         .agg(F.sum("order_qyt").alias("order_qyt"), F.sum("ori").alias("ori")))
    return w.select("monday_date", "week", "order_qyt", money("ori").alias("ori"),
                    ratio("ori", "order_qyt").alias("aov"))


def workday_orders(cat: Catalog, as_of: str, since: str, status: int = PAID) -> DataFrame:
    """Total orders on work days after ``since``."""
    day = workdays_only(_per_day(cat, as_of, status, since), cat.table("calendar"), "payday")
    return day.agg(F.sum("order_qyt").alias("order_qyt"))


def workday_orders_per_rack(cat: Catalog, as_of: str, since: str, status: int = PAID) -> DataFrame:
    """Average over work days of (orders / selling racks) that day."""
    day = workdays_only(_per_day(cat, as_of, status, since), cat.table("calendar"), "payday")
    return day.agg(F.round(F.avg(ratio("order_qyt", "machine_qyt")), ROUND).alias("order_mac"))


def workday_month(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Per month, work days only: buying users, orders, GMV and net sales."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt)
    # one roll-up to day x user, cut to work days, then to month x user: the user counts and the sums come from one scan
    per = (o.groupBy("month", "payday", "user_id")
           .agg(F.count("order_id").alias("order_qyt"), F.sum("origin_amount").alias("ori"),
                F.sum("actual_amount").alias("act")))
    per = workdays_only(per, cat.table("calendar"), "payday").groupBy("month", "user_id").agg(
        F.sum("order_qyt").alias("order_qyt"), F.sum("ori").alias("ori"), F.sum("act").alias("act"))
    return per.groupBy("month").agg(F.count("user_id").alias("user_qyt"), F.sum("order_qyt").alias("order_qyt"),
                                    money(F.sum("ori")).alias("ori"), money(F.sum("act")).alias("act"))


def workday_active_racks(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT,
                         status: int = PAID) -> DataFrame:
    """Per month: average over work days of the number of selling racks."""
    per = _day_rack(paid_orders(cat, as_of, status), month_fmt)
    day = per.groupBy("month", "payday").agg(F.count("machine_id").alias("machine_qyt"))
    day = workdays_only(day, cat.table("calendar"), "payday")
    return day.groupBy("month").agg(F.avg("machine_qyt").alias("machine_qyt"))


def period_total(cat: Catalog, as_of: str, since_day: str, status: int = PAID) -> DataFrame:
    """GMV and orders paid on or after day ``since_day``."""
    o = paid_orders(cat, as_of, status, since=day_start(since_day), since_inclusive=True)
    return o.agg(money(F.sum("origin_amount")).alias("ori"), F.count("order_id").alias("order_qyt"))
