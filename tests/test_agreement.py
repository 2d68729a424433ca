"""Duplicate formulations in the source must agree (on the sf0.01 test tables)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from rackpulse.functions.dates import month_key
from rackpulse.operators import inventory, marketing, racks, reports, sku, users
from rackpulse.operators.common import paid_orders
from rackpulse.plans import registry
from rackpulse.sources.fixtures import AS_OF
from tests.conftest import SF01


@pytest.fixture(scope="module")
def cat(spark):
    return registry.catalog_for(spark, SF01)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def triangular_buyers(cat):
    um = (paid_orders(cat, AS_OF).select(month_key("pay_complete_time").alias("month"), "user_id")
          .distinct().withColumn("key", F.lit(1)))
    a, b = um.alias("a"), um.alias("b")
    return (a.join(b, "key").where(F.col("a.month") >= F.col("b.month"))
            .groupBy(F.col("a.month").alias("month")).agg(F.countDistinct("b.user_id").alias("user_qyt")))


def test_cac_versions_agree(cat):
    a = rows(marketing.acquisition_cost(cat, AS_OF), "month", "CAC")
    b = rows(marketing.acquisition_cost_final(cat, AS_OF), "month", "CAC")
    assert a == b and len(a) > 10


def test_cumulative_buyers_first_seen_equals_triangular_join(cat):
    assert rows(users.cumulative_buyers(cat, AS_OF), "month", "user_qyt") == \
        rows(triangular_buyers(cat), "month", "user_qyt")


def test_last_cumulative_value_is_buyer_count(cat):
    cum = rows(users.cumulative_buyers(cat, AS_OF), "month", "user_qyt")
    assert cum[-1][1] == users.buyer_count(cat, AS_OF).first().user_qyt
    assert all(x[1] <= y[1] for x, y in zip(cum, cum[1:]))


def test_sku_monthly_columns_equal_reach_version(cat):
    cols = ("month", "sku_id", "commodity_name", "qyt", "ori", "act")
    assert rows(sku.sku_monthly(cat, AS_OF), *cols) == rows(sku.sku_monthly(cat, AS_OF, reach=True), *cols)


def test_sku_shares_sum_to_one(cat):
    s = sku.sku_share(cat, AS_OF).groupBy("month", "city_name").agg(
        F.sum("qyt_percent").alias("q"), F.sum("ori_percent").alias("o"))
    bad = s.where((F.abs(F.col("q") - 1) > 1e-9) | (F.abs(F.col("o") - 1) > 1e-9)).count()
    assert bad == 0


def test_rack_master_report_one_row_per_listed_rack(cat):
    rep = reports.rack_master_report(cat, AS_OF)
    listed = racks.rack_list(cat, AS_OF, require_city=False)
    assert rep.count() == listed.count() == rep.select("machine_id").distinct().count()


def test_pivot_totals_equal_monthly_totals(cat):
    piv = reports.rack_month_pivot(cat, AS_OF, months=tuple(range(1, 13)))
    tot = piv.agg(*[F.sum(f"order_qyt{m}").alias(f"o{m}") for m in range(1, 13)]).first()
    o = paid_orders(cat, AS_OF).groupBy(F.month("pay_complete_time").alias("m")).count()
    assert {r.m: r["count"] for r in o.collect()} == {m: tot[f"o{m}"] for m in range(1, 13) if tot[f"o{m}"]}


def test_turnover_uses_all_days_daily_units_work_days(cat):
    a = inventory.avg_daily_units(cat, AS_OF, registry.SINCE).first().qyt
    assert a > 0 and inventory.turnover_days(cat, AS_OF, registry.SINCE).first().zzdays > 0


def test_as_written_month_and_week_keys(cat):
    """``month_fmt="MM"`` merges years (as the source's month-of-year key does); totals are unchanged."""
    from rackpulse.operators import companies
    by_year = marketing.discount_roi(cat, AS_OF)
    merged = marketing.discount_roi(cat, AS_OF, month_fmt="MM")
    months = sorted(r.month for r in merged.collect())
    assert months == [f"{m:02d}" for m in range(1, 13)]
    tot = lambda df: df.agg(F.sum("cut")).first()[0]
    assert tot(by_year) == pytest.approx(tot(merged), rel=1e-12)   # sums of doubles in another order
    weeks = companies.company_weekly_sales(cat, AS_OF, week_key="week").select("weekno").distinct().collect()
    assert 1 <= min(r.weekno for r in weeks) and max(r.weekno for r in weeks) <= 53


def test_pivot_by_year_month_splits_month_of_year(cat):
    by_moy = reports.rack_month_pivot(cat, AS_OF, months=(12,))
    years = [f"{y}12" for y in range(1995, 2001)]
    by_ym = reports.rack_month_pivot(cat, AS_OF, months=tuple(years), month_col="month_id")
    a = by_moy.agg(F.sum("order_qyt12")).first()[0]
    b = by_ym.agg(*[F.sum(f"order_qyt{y}").alias(y) for y in years]).first()
    assert a == sum(b) and a > 0
