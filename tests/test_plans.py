"""Plan shape: partition pruning, pushed filters, top-N limits, no quadratic joins, no Python UDFs."""

import pytest

from rackpulse.operators import racks, reports, sales, users
from rackpulse.plans import registry
from rackpulse.sources.catalog import Catalog, snapshot
from rackpulse.sources.fixtures import AS_OF, fixture_catalog
from rackpulse.sources.sinks import materialise
from tests.conftest import SF001


def plan(df) -> str:
    # long pushed-filter lists are cut in plan text unless the metadata length limit is raised
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The sf0.001 logical tables written to parquet, those with snapshots partitioned by ``pt``."""
    root = str(tmp_path_factory.mktemp("warehouse"))
    lazy = fixture_catalog(spark, SF001)
    for name in ["rack", "rack_order", "order_item", "user_info", "company", "company_raw", "rack_grade"]:
        materialise(lazy.table(name), name, root, partition_by="pt" if "pt" in lazy.table(name).columns and name != "rack_grade" else None)
    names = [n for n in lazy.names()]
    loaders = {n: (lambda n=n: lazy.table(n)) for n in names}
    cat = Catalog.from_parquet(spark, root, ["rack", "rack_order", "order_item", "user_info", "company",
                                             "company_raw", "rack_grade"])
    for n in names:
        if n not in cat._loaders:
            cat._loaders[n] = loaders[n]
    return cat


def test_snapshot_is_partition_pruned(stored):
    p = plan(snapshot(stored.table("rack"), AS_OF))
    assert "PartitionFilters: [isnotnull(pt" in p and f"(pt#" in p and AS_OF in p


def test_paid_and_time_filters_reach_the_scan(stored):
    p = plan(sales.daily_kpis(stored, AS_OF, "1995-01-01 00:00:00"))
    assert "EqualTo(pay_status,64)" in p and "GreaterThan(pay_complete_time" in p


def test_top_n_uses_window_group_limit(stored):
    p = plan(reports.top_racks_sold_days(stored, AS_OF, "19950101"))
    assert "WindowGroupLimit" in p


def test_cumulative_buyers_has_no_nested_loop_join(stored):
    for df in (users.cumulative_buyers(stored, AS_OF), users.cumulative_buyers_range(stored, AS_OF)):
        p = plan(df)
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_every_snapshot_read_is_partition_pruned(stored):
    import re
    for df in (sales.daily_kpis(stored, AS_OF, registry.SINCE), users.new_user_ticket(stored, AS_OF),
               reports.rack_month_profit(stored, AS_OF, registry.SINCE_DAY)):
        scans = [x for x in plan(df).split("\n") if "FileScan parquet" in x and "pt#" in x]
        assert scans and all(re.search(r"PartitionFilters: \[[^\]]*" + AS_OF, x) for x in scans)


def test_no_forced_broadcast(stored):
    for name in ("weekly_kpis", "workday_month", "rack_month_pivot", "avg_daily_units"):
        logical = registry.REPORTS[name](stored)._jdf.queryExecution().logical().toString()
        assert "ResolvedHint" not in logical and "UnresolvedHint" not in logical, name


def test_band_reports_roll_up_before_the_rack_join(stored):
    from rackpulse.operators import companies
    for df in (companies.band_orders_gmv(stored, AS_OF), companies.band_users(stored, AS_OF),
               companies.band_users_total(stored, AS_OF)):
        lines = plan(df).split("\n")
        at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "/rack_order" in x)
        join = max(i for i, x in enumerate(lines[:at]) if "Join " in x)
        assert any("HashAggregate" in x for x in lines[join:at])


def test_one_order_scan(stored):
    from rackpulse.operators import marketing
    for df in (sales.workday_month(stored, AS_OF), marketing.coupon_vs_gmv(stored, AS_OF),
               users.cumulative_buyers(stored, AS_OF)):
        scans = [x for x in plan(df).split("\n") if "FileScan parquet" in x and "/rack_order" in x]
        assert len(scans) == 1


def test_column_pruning_on_order_scan(stored):
    p = plan(racks.city_count(stored, AS_OF))
    assert "ReadSchema: struct<release_status:int,city_name:string>" in p


def test_no_python_udf_in_any_report(spark):
    cat = registry.catalog_for(spark, SF001)
    for name, fn in registry.REPORTS.items():
        p = plan(fn(cat))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_distinct_users_per_month_shuffle_on_month_and_user(stored):
    # a hot month must not send all its user ids to one task: the first exchange is keyed on both
    import re
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan(sales.workday_month(stored, AS_OF)))
    assert any("month#" in k and "user_id#" in k for k in keys), keys


def test_first_order_per_user_is_a_partial_aggregate(stored):
    from rackpulse.operators import marketing
    p = plan(marketing.acquisition_cost(stored, AS_OF))
    assert "partial_min(" in p and "Window" not in p


def test_session_turns_on_adaptive_skew_handling(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
