"""SKU and category sales: monthly SKU figures, shares within a city, top-category volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.bitset import distinct_counts
from rackpulse.functions.dates import MONTH_FMT, month_key
from rackpulse.functions.ratio import line_amount, money, ratio
from rackpulse.operators.common import paid_items
from rackpulse.sources.catalog import PAID, Catalog, snapshot


def sku_share(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Per month x city x SKU: units and GMV (price x quantity), the city-month totals and the SKU's share
    of them.

    The totals are summed map-side from the (month, city, SKU) rows, before names are joined on, and
    joined back: no city-month is sorted in one task."""
    i = paid_items(cat, as_of, status).withColumn("month", month_key("pay_complete_time", month_fmt))
    c = snapshot(cat.table("commodity"), as_of).drop("pt")
    a = (i.groupBy("month", "city_name", "sku_id")
         .agg(F.sum("quantity").alias("qyt"), F.sum(line_amount("commodity_origin_price")).alias("ori"))
         .join(c, "sku_id"))
    t = a.groupBy(F.col("month").alias("m"), F.col("city_name").alias("city")).agg(
        F.sum("qyt").alias("city_qyt"), F.sum("ori").alias("city_ori"))
    j = a.join(t, F.col("month").eqNullSafe(F.col("m")) & F.col("city_name").eqNullSafe(F.col("city")))
    return j.select("month", "city_name", "sku_id", "commodity_name", "div_name", "dept_name", "class_name",
                    "subclass_name", "qyt", "city_qyt", ratio("qyt", "city_qyt").alias("qyt_percent"),
                    money("ori").alias("ori"), money("city_ori").alias("city_ori"),
                    ratio("ori", "city_ori").alias("ori_percent"))


def sku_monthly(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID,
                reach: bool = False) -> DataFrame:
    """Per month x SKU: units, GMV, net (price x quantity); with ``reach`` also distinct racks, users and
    orders, as bit sets in the same two roll-ups as the sums."""
    i = paid_items(cat, as_of, status).withColumn("month", month_key("pay_complete_time", month_fmt))
    keys = ["month", "sku_id", "commodity_name"]
    sums = {"qyt": F.col("quantity"), "ori": line_amount("commodity_origin_price"), "act": line_amount("commodity_sale_price")}
    cols = [*keys, "qyt", money("ori").alias("ori"), money("act").alias("act")]
    if not reach:
        return i.groupBy(*keys).agg(*[F.sum(v).alias(a) for a, v in sums.items()]).select(*cols)
    ids = {"machine_qyt": "machine_id", "user_qyt": "user_id", "order_qyt": "order_id"}
    return distinct_counts(i, keys, ids, sums).select(*cols, *ids)


def category_sales(cat: Catalog, as_of: str, months_of_year=(11, 12), month_fmt: str = MONTH_FMT,
                   status: int = PAID) -> DataFrame:
    """Orders and units per top category (``div_name``) in the given months of the year."""
    i = paid_items(cat, as_of, status).where(F.month("pay_complete_time").isin(list(months_of_year)))
    i = i.withColumn("month", month_key("pay_complete_time", month_fmt))
    # orders per (month, SKU): de-duplicate (month, SKU, order) first (shuffled on all three, so a
    # best-selling SKU spreads over many tasks), then count rows (combined map-side)
    per_order = i.groupBy("month", "sku_id", "order_id").agg(F.sum("quantity").alias("qyt"))
    a = per_order.groupBy("month", "sku_id").agg(F.count("order_id").alias("order_qyt"),
                                                F.sum("qyt").alias("qyt"))
    c = snapshot(cat.table("commodity"), as_of).select("sku_id", "div_name")
    return (a.join(c, "sku_id").groupBy("month", "div_name")
            .agg(F.sum("order_qyt").alias("order_qyt"), F.sum("qyt").alias("qyt")))
