"""Reports on hand-made rows: ties, missing partners, renames, blank headcounts, zero denominators."""

from decimal import Decimal

import pytest

from rackpulse.operators import companies, marketing, racks, reports, sales, users
from tests.helpers import AS_OF, catalog, order, rack


def test_first_order_tie_goes_to_lower_order_id(spark):
    # user 1 has two orders at the same first time: order 10 (no discount) and 11 (discount)
    cat = catalog(spark, rack_order=[
        order(11, 1, 100, "2017-06-01 00:00:00", 10, 7),
        order(10, 1, 100, "2017-06-01 00:00:00", 10, 10),
        order(12, 2, 100, "2017-06-02 00:00:00", 20, 15),
        order(13, 2, 100, "2017-07-02 00:00:00", 20, 5),
    ])
    r = marketing.acquisition_cost(cat, AS_OF).collect()
    # user 1's first order is 10 (not discounted) -> only user 2 counts
    assert [(x.month, x.cut, x.new_user, x.CAC) for x in r] == [("201706", 5.0, 1, 5.0)]


def test_rack_master_report_keeps_racks_without_orders_or_company(spark):
    cat = catalog(
        spark,
        rack=[rack(100, "A", 1), rack(101, "B", 1), rack(102, "C", 2, status=-1, city=None),
              rack(103, "D", 9, status=5)],
        company=[(1, "Corp1", "", AS_OF)],   # company 2 has no company row
        company_raw=[(1, "")],
        rack_order=[order(1, 7, 100, "2017-06-05 00:00:00", 10, 8), order(2, 8, 100, "2017-12-05 00:00:00", 4, 4)],
    )
    rep = reports.rack_master_report(cat, AS_OF)
    rows = {r.machine_id: r for r in rep.collect()}
    assert set(rows) == {100, 101, 102}             # status 5 is not listed
    assert rows[100].order_qyt6 == 1 and rows[100].user_qyt12 == 1 and rows[100].ori6 == 10.0
    assert rows[101].order_qyt6 is None              # no sales: left join keeps the rack
    assert rows[102].corp_name is None               # no company row
    assert rows[102].offline_date == "20170601"      # withdrawn and had been online
    assert rows[100].offline_date == "无"
    # company 1: '' headcount and 2 racks with a city -> first rule of the coarse imputation
    assert rows[100].total_people == "30~50" and rows[100].machine_qyt == 2


def test_company_without_racks_has_no_size_row(spark):
    cat = catalog(spark, rack=[rack(100, "A", 1)],
                  company=[(1, "C1", "120人", AS_OF), (2, "C2", "300", AS_OF)],
                  company_raw=[(1, "120人"), (2, "300")])
    got = {(r.customer_id, r.total_people, r.machine_qyt) for r in companies.company_size(cat, AS_OF).collect()}
    assert got == {(1, "120人", 1)}
    band = {(r.customer_id, r.total_people) for r in companies.company_band(cat, AS_OF).collect()}
    assert band == {(1, "100~299")}    # parsed text wins in the fine bands


def test_small_companies_blank_is_a_space_not_empty(spark):
    cat = catalog(spark, rack=[rack(100, "A", 1), rack(101, "B", 2), rack(102, "C", 3), rack(103, "D", 4)],
                  company=[(i, f"C{i}", None, AS_OF) for i in (1, 2, 3, 4)],
                  company_raw=[(1, " "), (2, ""), (3, None), (4, "40人")])
    got = {(r.customer_id, r.total_people) for r in companies.small_companies(cat, AS_OF).collect()}
    # ' ' and null take the second branch; '' is in neither; '40人' parses to 40 < 50
    assert got == {(1, " "), (3, None), (4, "40")}


def test_renamed_rack_between_snapshots_yields_two_rows(spark):
    snaps = [rack(100, "Old", 1, pt="20171101"), rack(100, "New", 1, pt="20171102"),
             rack(100, "New", 1, pt="20171103")]
    cat = catalog(spark, rack=snaps,
                  rack_order=[order(1, 7, 100, "2017-11-01 00:00:00", 10, 8)])
    rows = reports.top_racks_online_days(cat, AS_OF, "20171101", "20171101", "20171130").collect()
    assert sorted((r.machine_name, r.online_days, r.rn) for r in rows) == [("New", 2, 1), ("Old", 1, 2)]  # equal GMV: name breaks the tie


def test_repeat_rate_window_matches_self_join(spark):
    cohort = spark.createDataFrame(
        [("2017年1周", "2017年1周", 0, 10), ("2017年2周", "2017年1周", 1, 4), ("2017年3周", "2017年1周", 2, 0),
         ("2017年3周", "2017年2周", 1, 3)],   # cohort 2017年2周 has no size row: dropped like the inner join
        "week string, week_first string, cut int, user_num long")
    got = {(r.week_first, r.new_user, r.cut, r.user_num, r.buy_rate) for r in users.repeat_rate(cohort).collect()}
    assert got == {("2017年1周", 10, 1, 4, 0.4), ("2017年1周", 10, 2, 0, 0.0)}


def test_daily_kpis_zero_rows_when_nothing_paid(spark):
    cat = catalog(spark, rack=[rack(100, "A", 1)],
                  rack_order=[order(1, 7, 100, "2017-11-05 00:00:00", 10, 8, status=0)])
    assert sales.daily_kpis(cat, AS_OF, "2017-11-01 00:00:00").count() == 0


def test_since_bound_is_strict(spark):
    cat = catalog(spark, rack=[rack(100, "A", 1)],
                  rack_order=[order(1, 7, 100, "2017-12-01 00:00:00", 10, 8),
                              order(2, 7, 100, "2017-12-01 00:00:01", 10, 8)])
    r = sales.daily_kpis(cat, AS_OF, "2017-12-01 00:00:00").collect()
    assert [(x.payday, x.order_qyt) for x in r] == [("20171201", 1)]


def test_discount_roi_zero_discount_is_excluded_not_an_error(spark):
    cat = catalog(spark, rack_order=[order(1, 7, 100, "2017-12-01 00:00:00", 10, 10)])
    assert marketing.discount_roi(cat, AS_OF).count() == 0


def test_weekly_cohort_gap_across_new_year(spark):
    cat = catalog(spark)
    trades = spark.createDataFrame(
        [(2017, 52, 1, 1, Decimal("1.00")), (2018, 1, 1, 2, Decimal("1.00")), (2019, 1, 1, 3, Decimal("1.00"))],
        "year int, week_of_year int, user_id long, order_id long, origin_amount decimal(18,2)")
    firsts = spark.createDataFrame([(2017, 52, 1)], "year int, week_of_year int, user_id long")
    cat._loaders["trade_detail"] = lambda: trades
    cat._loaders["user_first_day"] = lambda: firsts
    got = {(r.week, r.week_first, r.cut, r.user_num) for r in users.weekly_cohort(cat).collect()}
    # 2017-12-25, 2018-01-01 and 2018-12-31 are the Mondays
    assert got == {("2017年52周", "2017年52周", 0, 1), ("2018年1周", "2017年52周", 1, 1), ("2019年1周", "2017年52周", 53, 1)}
    index = {(r.week, r.cut) for r in users.weekly_cohort(cat, second_year=2018).collect()}
    assert index == {("2017年52周", 0), ("2018年1周", 1), ("2019年1周", -51)}   # the index knows two years only


def test_grade_counts_and_city_count(spark):
    cat = catalog(spark, rack=[rack(100, "A", 1, city="X"), rack(101, "B", 1, city="Y", status=3),
                               rack(102, "C", 1, city="Z", status=-1)],
                  rack_grade=[(100, "A", "20171130"), (101, "A", "20171130"), (100, "B", "20171228"),
                              (100, "B", "20171228")])
    assert racks.city_count(cat, AS_OF).first().city_qyt == 2
    got = {(r.pt, r.machine_grading, r.machine_qyt) for r in racks.grade_counts(cat, ["20171130", "20171228"]).collect()}
    assert got == {("20171130", "A", 2), ("20171228", "B", 1)}


def test_order_detail_accepts_a_name_table(spark):
    from rackpulse.plans import registry
    from rackpulse.sources.fixtures import AS_OF as FIX
    from tests.conftest import SF001
    cat = registry.catalog_for(spark, SF001)
    names = registry.NAMED_RACKS
    as_list = reports.order_detail(cat, FIX, names)
    as_table = reports.order_detail(cat, FIX, spark.createDataFrame([(n,) for n in names], "machine_name string"))
    assert sorted(map(tuple, as_list.collect())) == sorted(map(tuple, as_table.collect()))


def test_calendar_holiday_override(spark):
    from rackpulse.operators.calendar import RESTDAY, WORKDAY, calendar
    hol = spark.createDataFrame([("20171002", RESTDAY), ("20170930", WORKDAY)], "day_id string, day_type string")
    cal = {r.day_id: r.day_type for r in calendar(spark, "2017-09-29", "2017-10-03", hol).collect()}
    assert cal == {"20170929": WORKDAY, "20170930": WORKDAY, "20171001": RESTDAY, "20171002": RESTDAY,
                   "20171003": WORKDAY}


def test_duplicate_holiday_does_not_double_the_day(spark):
    from rackpulse.operators.calendar import RESTDAY, WORKDAY, calendar
    hol = spark.createDataFrame([("20171002", RESTDAY), ("20171002", RESTDAY), ("20171003", WORKDAY),
                                 ("20171003", RESTDAY), ("20170929", None)], "day_id string, day_type string")
    cal = calendar(spark, "2017-09-29", "2017-10-03", hol).collect()
    assert len(cal) == 5
    got = {r.day_id: r.day_type for r in cal}
    assert got["20171002"] == RESTDAY and got["20171003"] == RESTDAY and got["20170929"] == WORKDAY


def test_null_buyers_are_no_people(spark):
    cat = catalog(spark, rack_order=[
        order(1, 1, 100, "2017-10-02 00:00:00", 10, 8), order(2, None, 100, "2017-10-02 00:00:00", 10, 8),
        order(3, None, 100, "2017-11-06 00:00:00", 5, 5), order(4, 2, 100, "2017-12-04 00:00:00", 10, 8),
        order(5, 1, 100, "2017-12-04 00:00:00", 10, 8)])
    cum = {r.month: r.user_qyt for r in users.cumulative_buyers(cat, AS_OF).collect()}
    assert cum == {"201710": 1, "201711": 1, "201712": 2}      # November holds a null buyer only
    assert users.buyer_count(cat, AS_OF).first().user_qyt == 2
    month = {r.month: (r.user_qyt, r.order_qyt, r.ori) for r in sales.workday_month(cat, AS_OF).collect()}
    assert month == {"201710": (1, 2, 20.0), "201711": (0, 1, 5.0), "201712": (2, 2, 20.0)}


def test_null_buyers_over_calendar_months(spark):
    line = lambda o, u, t: (o, 100, u, 1, "X", "c", Decimal("2.00"), Decimal("1.5000"), 3, t, 64, AS_OF)
    from tests.helpers import ts
    cat = catalog(spark, start="2017-10-01", order_item=[line(1, 1, ts("2017-10-02 00:00:00")),
                                                         line(2, None, ts("2017-11-02 00:00:00"))])
    got = {r.month_id: r.user_qty for r in users.cumulative_buyers_range(cat, AS_OF).collect()}
    assert got == {"201710": 1, "201711": 1, "201712": 1, "201801": 1}


def test_null_ids_are_not_counted_in_stock_suppliers_and_grades(spark):
    from rackpulse.operators import inventory
    cat = catalog(spark, rack_grade=[(100, "A", "20171130"), (None, "A", "20171130"), (None, "B", "20171130")])
    cat._loaders["stock_his"] = lambda: spark.createDataFrame(
        [(1, 5, 2, 1, "20171231"), (1, None, 2, 1, "20171231")],
        "machine_id long, sku_id long, max_inventory long, is_valid int, day_id string")
    cat._loaders["supplier_product_his"] = lambda: spark.createDataFrame(
        [("s", 1, "20171231"), (None, 1, "20171231")], "supplier_code string, is_valid int, day_id string")
    assert inventory.sku_count(cat, "20171231").first().sku_qyt == 1
    assert inventory.supplier_count(cat, "20171231").first().supplier_qyt == 1
    got = {(r.machine_grading, r.machine_qyt) for r in racks.grade_counts(cat, ["20171130"]).collect()}
    assert got == {("A", 1), ("B", 0)}


def test_null_account_user_is_no_viewer(spark):
    cat = catalog(spark)
    ev = [("2017-10-01 10:00:00", "t1"), ("2017-10-01 11:00:00", "t0"), ("2017-10-02 10:00:00", "t2")]
    cat._loaders["user_event"] = lambda: spark.createDataFrame(
        [(t, k, "app-openrack-h5", "commodity_list", "pv") for t, k in ev],
        "create_time string, token string, app_name string, page_name string, log_type string"
    ).selectExpr("cast(create_time as timestamp_ntz) create_time", "token", "app_name", "page_name", "log_type")
    cat._loaders["account_token"] = lambda: spark.createDataFrame(
        [("t1", 1), ("t2", 2), ("t0", None)], "token string, user_id long")
    got = {r.mon: r.sum_user for r in users.cumulative_viewers(cat, "yyyy-MM-dd").collect()}
    assert got == {"2017-10-01": 1, "2017-10-02": 2}


def test_orders_without_amount_have_no_part_in_the_average_ticket(spark):
    cat = catalog(spark, user_info=[(1, "20171001", AS_OF)], rack_order=[
        order(1, 1, 100, "2017-11-01 00:00:00", 10, 8)])
    cat._frames["rack_order"] = cat.table("rack_order").unionByName(spark.createDataFrame(
        [(2, 1, 100, "Shanghai", None, 64, None, None, AS_OF)], cat.table("rack_order").schema).selectExpr(
        "order_id", "user_id", "machine_id", "city_name", "timestamp_ntz'2017-11-02 00:00:00' pay_complete_time",
        "pay_status", "origin_amount", "actual_amount", "pt"))
    r = users.old_user_ticket(cat, AS_OF).collect()
    assert [(x.month, x.avg_ori) for x in r] == [("201711", 10.0)]


def test_duplicate_orders_are_reported(spark):
    cat = catalog(spark, rack_order=[order(1, 1, 100, "2017-11-01 00:00:00", 10, 8),
                                     order(1, 1, 100, "2017-11-01 00:00:00", 10, 8)])
    assert [(r.order_id, r.n_rows) for r in cat.duplicate_keys("rack_order").collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="rack_order"):
        cat.check_keys(["rack_order"])


def test_sku_amounts_are_price_times_quantity(spark):
    from rackpulse.operators import sku
    from tests.helpers import ts
    t = ts("2017-11-01 00:00:00")
    cat = catalog(spark, commodity=[(1, "tea", "d", "e", "f", "g", AS_OF), (2, "bun", "d", "e", "f", "g", AS_OF)],
                  order_item=[(1, 100, 7, 1, "X", "tea", Decimal("2.50"), Decimal("2.0000"), 3, t, 64, AS_OF),
                              (1, 100, 7, 1, "X", "tea", Decimal("2.50"), Decimal("2.5000"), 1, t, 64, AS_OF),
                              (2, 101, None, 2, "X", "bun", Decimal("1.00"), Decimal("1.0000"), 10, t, 64, AS_OF)])
    got = {r.sku_id: (r.qyt, r.ori, r.act, r.machine_qyt, r.user_qyt, r.order_qyt)
           for r in sku.sku_monthly(cat, AS_OF, reach=True).collect()}
    assert got == {1: (4, 10.0, 8.5, 1, 1, 1), 2: (10, 10.0, 10.0, 1, 0, 1)}
    assert {r.sku_id: r.ori_percent for r in sku.sku_share(cat, AS_OF).collect()} == {1: 0.5, 2: 0.5}


def test_coupons_of_orders_without_city_are_not_counted(spark):
    cat = catalog(spark, rack_order=[order(1, 1, 100, "2017-11-01 00:00:00", 10, 8),
                                     order(2, 1, 100, "2017-11-01 00:00:00", 10, 8, city=None),
                                     order(3, 1, 100, "2017-12-01 00:00:00", 10, 8)])
    cat._loaders["coupon"] = lambda: spark.createDataFrame(
        [(1, 1, Decimal("1.0")), (1, 2, Decimal("0.5")), (2, 1, Decimal("4.0")), (3, 3, Decimal("9.0"))],
        "order_id long, coupon_type int, discount_amount decimal(18,4)")
    got = [tuple(r) for r in marketing.coupon_vs_gmv(cat, AS_OF).collect()]
    assert got == [("201711", 1.0, 0.5, 20.0, 16.0)]
