"""Registered queries: report name -> call on the fixture catalog with fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rackpulse.operators import companies, inventory, marketing, racks, reports, sales, sku, users
from rackpulse.plans import kept
from rackpulse.sources.catalog import Catalog
from rackpulse.sources.fixtures import AS_OF, EARLIER, fixture_catalog
from rackpulse.sources.storage import by_order, buckets_for

# ---- fixed values: report parameters on the test tables ----
SINCE = "1994-12-31 00:00:00"          # strict lower pay-time bound of the 'since' reports: the day before the first
SINCE_DAY = "19950101"                 # first day of the day-bounded reports
PERIOD_SINCE_DAY = "20000101"          # first day of the period total
ONLINE_FROM, ONLINE_TO = "19950101", "20020101"   # racks put online in [from, to)
HOT_DAYS = ("19971129", "19971130")    # days of the rack-type report
HISTORY_DAY = "19971231"               # stock / supplier history day
SNAPSHOT_THEN = "19970731"             # earlier rack snapshot of the two-snapshot band report
GRADE_DAYS = ("19971130", "19971228")  # snapshot days of the grade counts
FIRST_PT, LAST_PT = "19950101", "20011130"   # daily rack snapshots counted as online days
NEW_USER_MONTH = 12                    # month-of-year of the new-user count
DETAIL_MONTH = "06"                    # month-of-year of the discounted-lines extract
NAMED_RACKS = tuple(f"Supplier#{i:09d}" for i in range(1, 13))  # the 12 racks of the detail extract
CUT_N = 5                              # racks per month of the cut top lists
SECOND_YEAR = 1996                     # year whose weeks the index form of the cohort numbers on
ONE_YEAR = 1997                        # year of the one-year cumulative buyers
MORE_DAYS, MORE_TYPE = tuple(f"199706{d:02d}" for d in range(1, 6)), 10   # a longer day list, the common rack type
VIEW_PERIOD = "yyyy-MM-dd"             # events cover one month: cumulate viewers per day
BUCKETS = 8                            # least buckets of the facts stored by order
# ---- end of fixed values ----

A = AS_OF


def _by_order(cat: Catalog) -> Catalog:
    return by_order(cat, buckets_for(cat, BUCKETS))


REPORTS: dict[str, Callable[[Catalog], DataFrame]] = {
    # headcount chain
    "headcount_length": lambda c: companies.headcount_length(c),
    "headcount_parsed": lambda c: companies.headcount_parsed(c),
    "size_distribution": lambda c: companies.size_distribution(c, A, ONLINE_FROM, ONLINE_TO),
    "small_companies": lambda c: companies.small_companies(c, A),
    "company_weekly_sales": lambda c: companies.company_weekly_sales(c, A),
    "rack_grade_detail": lambda c: companies.rack_grade_detail(c, A),
    "company_size": lambda c: companies.company_size(c, A),
    "racks_by_band": lambda c: companies.racks_by_band(c, A),
    "company_band": lambda c: companies.company_band(c, A),
    "active_racks_by_band": lambda c: companies.active_racks_by_band(c, A),
    "racks_by_band_two_snapshots": lambda c: companies.racks_by_band_two_snapshots(c, SNAPSHOT_THEN, A, A),
    "band_monthly_sales": lambda c: companies.band_monthly_sales(c, A, A),
    "band_monthly_sales_two_snapshots": lambda c: companies.band_monthly_sales(c, A, SNAPSHOT_THEN),
    "band_orders_gmv": lambda c: companies.band_orders_gmv(c, A),
    "band_users": lambda c: companies.band_users(c, A),
    "band_users_total": lambda c: companies.band_users_total(c, A),
    # racks
    "city_count": lambda c: racks.city_count(c, A),
    "rack_list": lambda c: racks.rack_list(c, A),
    "daily_online_vs_active": lambda c: racks.daily_online_vs_active(c, A),
    "grade_counts": lambda c: racks.grade_counts(c, GRADE_DAYS),
    # sales
    "daily_kpis": lambda c: sales.daily_kpis(c, A, since=SINCE),
    "rack_type_orders": lambda c: sales.rack_type_orders(c, A, HOT_DAYS),
    "rack_type_orders_days": lambda c: sales.rack_type_orders(c, A, MORE_DAYS, MORE_TYPE),
    "period_total_earlier": lambda c: sales.period_total(c, EARLIER, SINCE_DAY),
    "weekly_kpis": lambda c: sales.weekly_kpis(c, A),
    "workday_orders": lambda c: sales.workday_orders(c, A, SINCE),
    "workday_orders_per_rack": lambda c: sales.workday_orders_per_rack(c, A, SINCE),
    "workday_month": lambda c: sales.workday_month(c, A),
    "workday_active_racks": lambda c: sales.workday_active_racks(c, A),
    "period_total": lambda c: sales.period_total(c, A, PERIOD_SINCE_DAY),
    # users
    "new_users_in_month": lambda c: users.new_users_in_month(c, A, NEW_USER_MONTH),
    "month_users_and_new": lambda c: users.month_users_and_new(c, A),
    "cumulative_buyers": lambda c: users.cumulative_buyers(c, A),
    "buyer_count": lambda c: users.buyer_count(c, A),
    "new_user_frequency": lambda c: users.new_user_frequency(c, A),
    "old_user_frequency": lambda c: users.old_user_frequency(c, A),
    "cumulative_buyers_range": lambda c: users.cumulative_buyers_range(c, A),
    "cumulative_buyers_year": lambda c: users.cumulative_buyers_range(c, A, ONE_YEAR),
    "weekly_cohort_index": lambda c: users.weekly_cohort(c, SECOND_YEAR),
    "new_user_spend": lambda c: users.new_user_spend(c, A),
    "new_user_orders": lambda c: users.new_user_orders(c, A),
    "old_user_ticket": lambda c: users.old_user_ticket(c, A),
    "new_user_ticket": lambda c: users.new_user_ticket(c, A),
    "cumulative_viewers": lambda c: users.cumulative_viewers(c, VIEW_PERIOD),
    "weekly_cohort": lambda c: users.weekly_cohort(c),
    "repeat_rate": lambda c: users.repeat_rate(users.weekly_cohort(c)),
    # marketing
    "coupon_vs_gmv": lambda c: marketing.coupon_vs_gmv(c, A),
    "acquisition_cost": lambda c: marketing.acquisition_cost(c, A),
    "acquisition_cost_final": lambda c: marketing.acquisition_cost_final(c, A),
    "discount_roi": lambda c: marketing.discount_roi(c, A),
    # sku
    "sku_share": lambda c: sku.sku_share(c, A),
    "sku_monthly": lambda c: sku.sku_monthly(c, A),
    "sku_monthly_reach": lambda c: sku.sku_monthly(c, A, reach=True),
    "category_sales": lambda c: sku.category_sales(c, A),
    # inventory
    "avg_full_stock": lambda c: inventory.avg_full_stock(c),
    "avg_daily_units": lambda c: inventory.avg_daily_units(c, A, SINCE),
    "sku_count": lambda c: inventory.sku_count(c, HISTORY_DAY),
    "supplier_count": lambda c: inventory.supplier_count(c, HISTORY_DAY),
    "turnover_days": lambda c: inventory.turnover_days(c, A, SINCE),
    "avg_full_stock_hist": lambda c: inventory.avg_full_stock_hist(c, HISTORY_DAY),
    # rack reports
    "rack_month_pivot": lambda c: reports.rack_month_pivot(c, A),
    "rack_master_report": lambda c: reports.rack_master_report(c, A),
    "top_racks_sold_days": lambda c: reports.top_racks_sold_days(c, A, SINCE_DAY),
    "top_racks_online_days": lambda c: reports.top_racks_online_days(c, A, SINCE_DAY, FIRST_PT, LAST_PT),
    "top_racks_sold_days_cut": lambda c: reports.top_racks_sold_days(c, A, SINCE_DAY, CUT_N),
    "top_racks_online_days_cut": lambda c: reports.top_racks_online_days(c, A, SINCE_DAY, FIRST_PT, LAST_PT, CUT_N),
    "rack_month_profit": lambda c: reports.rack_month_profit(c, A, SINCE_DAY),
    "order_detail": lambda c: reports.order_detail(c, A, NAMED_RACKS),
    "discounted_order_items": lambda c: reports.discounted_order_items(c, A, DETAIL_MONTH),
}

#: Reports on kept tables, each under the key of the plain report that gives the same rows (None: its own SQL).
KEPT: dict[str, tuple[str | None, Callable[[Catalog], DataFrame]]] = {
    "derived_table_rows": (None, lambda c: kept.derived_table_rows(c, A)),
    "repeat_rate_stored": ("repeat_rate", lambda c: kept.repeat_rate_stored(c, A)),
    "top_racks_online_days_intervals": ("top_racks_online_days_cut", lambda c: kept.top_racks_online_days(
        c, A, SINCE_DAY, FIRST_PT, LAST_PT, CUT_N)),
    "daily_online_vs_active_intervals": ("daily_online_vs_active", lambda c: kept.daily_online_vs_active(c, A)),
    "grade_counts_intervals": ("grade_counts", lambda c: kept.grade_counts(c, GRADE_DAYS)),
    "cumulative_buyers_first_seen": ("cumulative_buyers", lambda c: kept.cumulative_buyers(c, A)),
    "acquisition_cost_first_seen": ("acquisition_cost", lambda c: kept.acquisition_cost(c, A)),
    "coupon_vs_gmv_by_order": ("coupon_vs_gmv", lambda c: marketing.coupon_vs_gmv(_by_order(c), A)),
    "order_detail_by_order": ("order_detail", lambda c: reports.order_detail(_by_order(c), A, NAMED_RACKS)),
    "discounted_order_items_by_order": ("discounted_order_items", lambda c: reports.discounted_order_items(
        _by_order(c), A, DETAIL_MONTH)),
}


def catalog_for(spark: SparkSession, sf_dir: str) -> Catalog:
    return fixture_catalog(spark, sf_dir)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the report on a fresh catalog (only DataFrame definitions: cheap, and never tied to a
    stopped session)."""
    report = REPORTS[name] if name in REPORTS else KEPT[name][1]
    return report(fixture_catalog(spark, sf_dir))
