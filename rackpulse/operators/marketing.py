"""Discounts: acquisition cost of new users, discount return, coupon spend next to GMV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.dates import MONTH_FMT, month_key
from rackpulse.functions.ratio import money, ratio
from rackpulse.operators.common import first_per_key, paid_orders, with_keys
from rackpulse.sources.catalog import PAID, Catalog


def coupon_vs_gmv(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, coupon_types=(1, 2),
                  status: int = PAID) -> DataFrame:
    """Per month: discount of coupon types 1 and 2 (one row per coupon, as in the source) beside GMV
    and net sales of all paid orders. Coupons are summed per order before the join, so the join
    sees one row per order on each side."""
    t1, t2 = coupon_types
    cp = (cat.table("coupon").where(F.col("coupon_type").isin(list(coupon_types)))
          .groupBy("order_id")
          .agg(F.sum(F.when(F.col("coupon_type") == t1, F.col("discount_amount")).otherwise(0)).alias("c1"),
               F.sum(F.when(F.col("coupon_type") == t2, F.col("discount_amount")).otherwise(0)).alias("c2")))
    # one pass over the orders: coupons are joined on, and counted where the order has a city
    o = with_keys(paid_orders(cat, as_of, status), month_fmt).join(cp, "order_id", "left")
    counted = F.col("city_name").isNotNull() & F.col("c1").isNotNull()
    g = o.groupBy("month").agg(F.sum(F.when(counted, F.col("c1"))).alias("cut_1"),
                               F.sum(F.when(counted, F.col("c2"))).alias("cut_2"), F.count(F.when(counted, 1)).alias("n"),
                               F.sum("origin_amount").alias("GMV"), F.sum("actual_amount").alias("act"))
    # a month without such an order has no row, as in a join of the two sums
    return g.where("n > 0 and month is not null").select(
        "month", money("cut_1").alias("cut_1"), money("cut_2").alias("cut_2"), money("GMV").alias("GMV"),
        money("act").alias("act"))


def _discounted_first_orders(cat: Catalog, as_of: str, month_fmt: str, status: int, first: DataFrame | None) -> DataFrame:
    if first is None:
        o = paid_orders(cat, as_of, status)
        first = first_per_key(o, "user_id", ["pay_complete_time", "order_id"], ["origin_amount", "actual_amount"])
    return (first.where(F.col("origin_amount") > F.col("actual_amount"))
            .withColumn("month", month_key("pay_complete_time", month_fmt)))


def acquisition_cost(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID,
                     firsts: DataFrame | None = None) -> DataFrame:
    """Per month: discount given on users' first orders (when discounted), new users, and the
    acquisition cost = discount / new users. Ties on the first pay time go to the lower order id. ``firsts`` is a kept
    first-order table (``sources.firsts``), read instead of all orders."""
    f = _discounted_first_orders(cat, as_of, month_fmt, status, firsts)
    g = f.groupBy("month").agg(F.sum(F.col("origin_amount") - F.col("actual_amount")).alias("cut"),
                               F.count("user_id").alias("new_user"))
    return g.select("month", money("cut").alias("cut"), "new_user", ratio("cut", "new_user").alias("CAC"))


def acquisition_cost_final(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """The acquisition cost alone (the version marked final)."""
    return acquisition_cost(cat, as_of, month_fmt, status).select("month", "CAC")


def discount_roi(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Per month over discounted orders: GMV, net, discount and return = net / discount."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt)
    o = o.where(F.col("origin_amount") > F.col("actual_amount"))
    g = o.groupBy("month").agg(F.sum("origin_amount").alias("ori"), F.sum("actual_amount").alias("act"),
                               F.sum(F.col("origin_amount") - F.col("actual_amount")).alias("cut"))
    return g.select("month", money("ori").alias("ori"), money("act").alias("act"), money("cut").alias("cut"),
                    ratio("act", "cut").alias("ROI"))
