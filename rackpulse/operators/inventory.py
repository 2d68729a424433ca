"""Stock: full capacity per rack, units sold per day, turnover days, SKU and supplier counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.agg import distinct_count
from rackpulse.functions.dates import day_key
from rackpulse.functions.ratio import ratio
from rackpulse.operators.calendar import workdays_only
from rackpulse.operators.common import paid_items
from rackpulse.sources.catalog import PAID, Catalog, snapshot

ROUND = 6


def _capacity(stock: DataFrame) -> DataFrame:
    return (stock.where(F.col("is_valid") == 1).groupBy("machine_id")
            .agg(F.sum("max_inventory").alias("max_inventory")))


def avg_full_stock(cat: Catalog) -> DataFrame:
    """Average over racks of the summed full stock of their valid SKUs."""
    return _capacity(cat.table("stock")).agg(F.avg("max_inventory").alias("max_inventory"))


def avg_full_stock_hist(cat: Catalog, day: str) -> DataFrame:
    """``avg_full_stock`` on the stock history at ``day``."""
    return _capacity(snapshot(cat.table("stock_his"), day, "day_id")).agg(
        F.avg("max_inventory").alias("max_inventory"))


def _daily_units(cat: Catalog, as_of: str, since: str, status: int) -> DataFrame:
    i = paid_items(cat, as_of, status, since=since)
    return (i.groupBy("machine_id", day_key("pay_complete_time").alias("payday"))
            .agg(F.sum("quantity").alias("qyt")))


def avg_daily_units(cat: Catalog, as_of: str, since: str, status: int = PAID) -> DataFrame:
    """Average over racks of the rack's average units sold per work day."""
    d = workdays_only(_daily_units(cat, as_of, since, status), cat.table("calendar"), "payday")
    per_rack = d.groupBy("machine_id").agg(F.avg("qyt").alias("qyt"))
    return per_rack.agg(F.round(F.avg("qyt"), ROUND).alias("qyt"))


def turnover_days(cat: Catalog, as_of: str, since: str, status: int = PAID) -> DataFrame:
    """Average over racks of full stock / average units sold per selling day (all days)."""
    per_rack = _daily_units(cat, as_of, since, status).groupBy("machine_id").agg(F.avg("qyt").alias("qyt"))
    j = _capacity(cat.table("stock")).join(per_rack, "machine_id")
    return j.agg(F.round(F.avg(ratio("max_inventory", "qyt")), ROUND).alias("zzdays"))


def sku_count(cat: Catalog, day: str) -> DataFrame:
    """Distinct valid SKUs on racks at history day ``day``."""
    s = snapshot(cat.table("stock_his"), day, "day_id").where(F.col("is_valid") == 1)
    return distinct_count(s, [], "sku_id", "sku_qyt")


def supplier_count(cat: Catalog, day: str) -> DataFrame:
    """Distinct valid suppliers at history day ``day``."""
    s = snapshot(cat.table("supplier_product_his"), day, "day_id").where(F.col("is_valid") == 1)
    return distinct_count(s, [], "supplier_code", "supplier_qyt")
