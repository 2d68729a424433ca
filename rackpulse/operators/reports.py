"""Rack-level reports: monthly pivot, rack master report, top racks, rack-month profit, detail lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.functions.bitset import bit, has_bit
from rackpulse.functions.dates import MONTH_FMT, day_start, month_key, month_of_day_key
from rackpulse.functions.ratio import line_amount, money, ratio
from rackpulse.operators.common import paid_orders, racks_at, with_keys
from rackpulse.operators.companies import company_size, headcount_detail
from rackpulse.operators.racks import LISTED, online_days, rack_list
from rackpulse.sources.catalog import PAID, Catalog, snapshot

PIVOT_MONTHS = (6, 7, 8, 9, 10, 11, 12)  # fixed value: month-of-year columns of the monthly pivot
TOP_N = 1000                             # fixed value: racks kept per month in the top-rack reports


def rack_month_pivot(cat: Catalog, as_of: str, months=PIVOT_MONTHS, status: int = PAID,
                     month_col: str = "month_short_id") -> DataFrame:
    """One row per selling rack; for each calendar month M in ``months``: orders, distinct buyers,
    GMV and net sales (0 when none). ``month_col`` is the calendar column the months refer to:
    ``month_short_id`` (month of year, merging years, as in the source) or ``month_id`` (``yyyyMM``).

    Amounts are rolled up to (rack, day) and meet the calendar there. Buyers are a bit set of months per (rack, user), so
    that a user who buys in several months is one row, and a month's buyers are the sum of its bit."""
    if len(months) > 63:
        raise ValueError("a bit set holds 63 months at most")
    o = with_keys(paid_orders(cat, as_of, status))
    cal = cat.table("calendar").select(F.col("day_id").alias("payday"), F.col(month_col).alias("m"))
    days = o.groupBy("machine_id", "payday").agg(F.count("order_id").alias("order_qyt"), F.sum("origin_amount").alias("ori"),
                                                 F.sum("actual_amount").alias("act")).join(cal, "payday")
    place = F.coalesce(*[F.when(F.col("m") == mo, F.lit(i)) for i, mo in enumerate(months)])
    buyers = (o.select("machine_id", "user_id", "payday").join(cal.select("payday", bit(place).alias("_month")), "payday")
              .where(F.col("user_id").isNotNull()).groupBy("machine_id", "user_id").agg(F.bit_or("_month").alias("_months")))
    # amounts per day and bit sets per buyer meet in the last roll-up, both combined map-side
    rows = days.drop("payday").unionByName(buyers.drop("user_id"), allowMissingColumns=True)
    aggs = []
    for i, mo in enumerate(months):
        hit = F.col("m") == mo
        aggs += [F.sum(F.when(hit, F.col("order_qyt")).otherwise(0)).alias(f"order_qyt{mo}"),
                 F.count(F.when(has_bit(F.col("_months"), F.lit(i)), F.lit(1))).alias(f"user_qyt{mo}"),
                 F.sum(F.when(hit, F.col("ori")).otherwise(0)).alias(f"ori{mo}"),
                 F.sum(F.when(hit, F.col("act")).otherwise(0)).alias(f"act{mo}")]
    g = rows.groupBy("machine_id").agg(*aggs)
    cols = ["machine_id"]
    for mo in months:
        cols += [f"order_qyt{mo}", f"user_qyt{mo}", money(f"ori{mo}").alias(f"ori{mo}"),
                 money(f"act{mo}").alias(f"act{mo}")]
    return g.select(*cols)


def rack_master_report(cat: Catalog, as_of: str, months=PIVOT_MONTHS, status: int = PAID) -> DataFrame:
    """Every listed rack (any city) with its company (name, imputed headcount, rack count) and the
    monthly pivot; companies and sales are left-joined, so a rack without them keeps its row."""
    a = rack_list(cat, as_of, LISTED, require_city=False)
    b = company_size(cat, as_of, keep_name=True)
    c = rack_month_pivot(cat, as_of, months, status)
    j = a.join(b, "customer_id", "left").join(c, "machine_id", "left")
    pivot_cols = [x for x in c.columns if x != "machine_id"]
    return j.select("machine_id", "machine_name", "customer_id", "machine_type_name", "machine_sub_type_name",
                    "address", "online_date", "offline_date", "city_name", "corp_name", "total_people",
                    "machine_qyt", *pivot_cols)


def _month_rack(cat: Catalog, as_of: str, since_day: str, month_fmt: str, status: int) -> DataFrame:
    """Per (month, rack): orders, GMV, and days with sales, from day ``since_day`` on."""
    o = with_keys(paid_orders(cat, as_of, status, since=day_start(since_day), since_inclusive=True), month_fmt)
    per_day = o.groupBy("month", "payday", "machine_id").agg(F.count("order_id").alias("order_qyt"),
                                                             F.sum("origin_amount").alias("ori"))
    return per_day.groupBy("month", "machine_id").agg(F.sum("order_qyt").alias("order_qyt"),
                                                      F.sum("ori").alias("ori"),
                                                      F.count("payday").alias("days"))


def top_racks_sold_days(cat: Catalog, as_of: str, since_day: str, n: int = TOP_N,
                        month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Top ``n`` racks per month by GMV, with orders and GMV per selling day (ties: lower rack id)."""
    b = _month_rack(cat, as_of, since_day, month_fmt, status)
    w = Window.partitionBy("month").orderBy(F.col("ori").desc(), F.col("machine_id"))
    r = b.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return r.select("month", "machine_id", F.col("order_qyt").alias("leiji_order"),
                    money("ori").alias("leiji_ori"), F.col("days").alias("leiji_days"),
                    ratio("order_qyt", "days").alias("order_day"), ratio("ori", "days").alias("ori_day"), "rn")


def top_racks_online_days(cat: Catalog, as_of: str, since_day: str, first_pt: str, last_pt: str,
                          n: int = TOP_N, month_fmt: str = MONTH_FMT, status: int = PAID,
                          online: DataFrame | None = None) -> DataFrame:
    """Top ``n`` racks per month by GMV, with orders and GMV per day the rack was online (from the
    daily rack snapshots ``first_pt..last_pt``, or given as ``online``, e.g. from intervals). A rack renamed within a month yields one row per
    name, as in the source."""
    a = _month_rack(cat, as_of, since_day, month_fmt, status).drop("days")
    b = online_days(cat, first_pt, last_pt, month_fmt=month_fmt) if online is None else online
    j = a.join(b, ["month", "machine_id"])
    w = Window.partitionBy("month").orderBy(F.col("ori").desc(), F.col("machine_id"), F.col("machine_name"))
    r = j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return r.select("month", "machine_id", "machine_name", "order_qyt", money("ori").alias("ori"), "online_days",
                    ratio("order_qyt", "online_days").alias("order_day"),
                    ratio("ori", "online_days").alias("ori_day"), "rn")


def rack_month_profit(cat: Catalog, as_of: str, since_day: str, month_fmt: str = MONTH_FMT,
                      status: int = PAID) -> DataFrame:
    """Per month x rack: orders, GMV, net, purchase cost, buyers (summed over days) and new buyers
    (buyers whose first order day is that day, summed over days)."""
    o = with_keys(paid_orders(cat, as_of, status, since=day_start(since_day), since_inclusive=True))
    a = o.groupBy("payday", "machine_id", "user_id").agg(
        F.count("order_id").alias("order_qyt"), F.sum("origin_amount").alias("ori"),
        F.sum("actual_amount").alias("act"))
    u = snapshot(cat.table("user_info"), as_of).select("user_id", "rack_first_order")
    a = a.join(u, "user_id", "left")
    c = a.groupBy("payday", "machine_id").agg(
        F.sum("order_qyt").alias("order_qyt"), F.sum("ori").alias("ori"), F.sum("act").alias("act"),
        F.count("user_id").alias("user_qyt"),
        F.count(F.when(F.col("payday") == F.col("rack_first_order"), F.col("user_id"))).alias("new_user"))
    p = (cat.table("rack_cost").select("pt", "machine_id", "order_count", "list_amount", "sale_amount",
                                       "moving_cost").distinct()
         .select(F.col("pt").alias("payday"), "machine_id", "moving_cost"))
    m = racks_at(cat, as_of).select("machine_id", "machine_name")
    j = c.join(p, ["payday", "machine_id"], "left").join(m, "machine_id", "left")
    g = j.groupBy(month_of_day_key("payday", month_fmt).alias("month"), "machine_id", "machine_name").agg(
        F.sum("order_qyt").alias("order_qyt"), F.sum("ori").alias("ori"), F.sum("act").alias("act"),
        F.sum("moving_cost").alias("moving_cost"), F.sum("user_qyt").alias("user_qyt"),
        F.sum("new_user").alias("new_user"))
    return g.select("month", "machine_id", "machine_name", "order_qyt", money("ori").alias("ori"),
                    money("act").alias("act"), money("moving_cost").alias("moving_cost"), "user_qyt", "new_user")


def _ts_text(c: str):
    """Detail extracts print times as ``yyyy-MM-dd HH:mm:ss`` text (same value in every client,
    whatever its timestamp unit)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def order_detail(cat: Catalog, as_of: str, names, status: int = PAID) -> DataFrame:
    """Order lines of the racks named in ``names`` (a list, or a DataFrame with ``machine_name``) with
    the company's headcount. The named racks are selected before any join, so the fact scan is joined
    with that short list only (and Spark's runtime bloom filter can prune the order side)."""
    m = racks_at(cat, as_of)
    if isinstance(names, DataFrame):
        # a long list arrives as a table (column machine_name): a semi join instead of a huge IN list
        m = m.join(names.select("machine_name").distinct(), "machine_name", "left_semi")
    else:
        m = m.where(F.col("machine_name").isin(list(names)))
    m = m.select("machine_id", "machine_name", "customer_id")
    a = m.join(headcount_detail(cat, as_of), "customer_id").select("machine_id", "machine_name", "total_people")
    if not isinstance(names, DataFrame):
        # the racks of a list are few, which the planner can't tell: it would shuffle all order lines by rack to find out
        a = F.broadcast(a)
    i = snapshot(cat.table("order_item"), as_of)
    o = paid_orders(cat, as_of, status).select("order_id", "origin_amount")
    j = i.join(a, "machine_id").join(o, "order_id")
    return j.select("machine_id", "machine_name", "total_people", "order_id", money("origin_amount").alias("origin_amount"),
                    _ts_text("pay_complete_time"), "sku_id", "commodity_name",
                    money("commodity_origin_price").alias("commodity_origin_price"),
                    money("commodity_sale_price").alias("commodity_sale_price"), "quantity")


def discounted_order_items(cat: Catalog, as_of: str, month: str = "06", month_fmt: str = "MM",
                           status: int = PAID) -> DataFrame:
    """Order lines of discounted paid orders paid in ``month`` (``MM`` = that month of every year)."""
    o = (paid_orders(cat, as_of, status)
         .where((month_key("pay_complete_time", month_fmt) == month)
                & (F.col("origin_amount") > F.col("actual_amount"))).select("order_id"))
    i = snapshot(cat.table("order_item"), as_of)
    j = o.join(i, "order_id")
    return j.select("order_id", "machine_id", "user_id", "sku_id", "city_name", "commodity_name",
                    money("commodity_origin_price").alias("commodity_origin_price"),
                    money("commodity_sale_price").alias("commodity_sale_price"), "quantity",
                    money(line_amount("commodity_origin_price")).alias("origin_line"),
                    money(line_amount("commodity_sale_price")).alias("sale_line"),
                    _ts_text("pay_complete_time"), "pay_status", "pt")
