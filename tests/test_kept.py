"""Kept tables: bit-set counts, intervals built day by day, first-seen tables, facts stored by day and by order."""

import random

import pytest
from pyspark.sql import functions as F

from rackpulse.functions.bitset import distinct_counts
from rackpulse.operators import marketing, racks, reports, sales, sku, users
from rackpulse.plans import registry
from rackpulse.sources import intervals
from rackpulse.sources.firsts import FirstSeen
from rackpulse.sources.storage import by_day, by_order
from tests.conftest import SF001
from tests.helpers import AS_OF, catalog, order, rack
from tests.test_plans import plan


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bit_sets_count_as_distinct_does(spark):
    rng = random.Random(1)
    ids = [None, 0, -1, -64, -65, 63, 64, 1 << 40, -(1 << 62), (1 << 63) - 1, *range(300)]
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice(ids), rng.choice(ids[:8]), rng.randrange(9)) for _ in range(3000)]
    rows += [("only nulls", None, None, 1)] * 3
    df = spark.createDataFrame(rows, "k string, a long, b long, v long")
    got = distinct_counts(df, ["k"], {"n_a": "a", "n_b": "b"}, {"total": F.col("v")})
    want = df.groupBy("k").agg(F.sum("v").alias("total"), F.countDistinct("a").alias("n_a"), F.countDistinct("b").alias("n_b"))
    assert rows_of(got.select("k", "total", "n_a", "n_b")) == rows_of(want)
    assert distinct_counts(df.limit(0), ["k"], {"n": "a"}, {"t": F.col("v")}).collect() == []


def test_reach_has_no_expand_and_the_pivot_no_month_in_its_buyers_shuffle(spark):
    cat = registry.catalog_for(spark, SF001)
    assert "Expand" not in plan(sku.sku_monthly(cat, registry.A, reach=True))
    p = plan(reports.rack_month_pivot(cat, registry.A))
    buyers = [x for x in p.split("\n") if "hashpartitioning(machine_id" in x and "user_id" in x]
    assert buyers and not any(" m#" in x.split("hashpartitioning")[1].split(")")[0] for x in buyers)
    assert "bit_or" in p


def test_cohort_bits_keep_trades_without_week_or_user(spark):
    trades = [(2017, 52, 1, 1, 1), (2017, 52, 1, 2, 1), (2018, 1, 1, 3, 1), (2018, 1, 2, 4, 1), (2018, None, 2, 5, 1), (2018, 9, None, 6, 1),
              (2018, 2, 3, 7, 1)]
    cat = catalog(spark)
    cat._loaders["trade_detail"] = lambda: spark.createDataFrame(
        trades, "year int, week_of_year int, user_id long, order_id long, origin_amount long")
    cat._loaders["user_first_day"] = lambda: spark.createDataFrame(
        [(2017, 52, 1), (2018, 1, 2), (2018, 1, 2)], "year int, week_of_year int, user_id long")
    want = [("2017年52周", "2017年52周", 0, 1), ("2018年1周", "2017年52周", 1, 1), ("2018年1周", "2018年1周", 0, 1),
            (None, "2018年1周", None, 1), ("2018年9周", None, None, 0), ("2018年2周", None, None, 1)]
    assert rows_of(users.weekly_cohort(cat)) == sorted(want, key=repr)


# ---- intervals

def snapshots(seed=5, days=40):
    """(machine_id, machine_name, machine_type, release_status, pt): racks come, change, go and return; some days lack a snapshot."""
    rng, rows, state = random.Random(seed), [], {m: None for m in range(12)}
    for d in range(days):
        pt = f"2017{11 + d // 30:02d}{d % 30 + 1:02d}"
        for m in state:
            if rng.random() < 0.25:
                state[m] = None if rng.random() < 0.3 else (f"R{m}" if rng.random() < 0.9 else None, 10 * rng.randrange(1, 4), rng.choice([2, 3, -1]))
        if d % 11 != 4:
            rows += [(m, *s, pt) for m, s in state.items() if s]
    return rows


SNAPSHOT = "machine_id long, machine_name string, machine_type int, release_status int, pt string"


@pytest.fixture(scope="module")
def kept(spark):
    df = spark.createDataFrame(snapshots(), SNAPSHOT).cache()
    days = intervals.snapshot_days(df).cache()
    return df, days, intervals.build(df, racks.INTERVAL_COLUMNS).cache()


def test_intervals_day_by_day_equal_a_rebuild(spark, kept):
    df, days, whole = kept
    numbers = sorted((r.day_no, r.pt) for r in days.collect())
    head = numbers[:25]
    grown = intervals.build(df.where(F.col("pt") <= head[-1][1]), racks.INTERVAL_COLUMNS)
    for number, pt in numbers[25:33]:
        grown = intervals.add_day(grown, df.where(F.col("pt") == pt), racks.INTERVAL_COLUMNS, number, pt)
        grown = spark.createDataFrame(grown.collect(), grown.schema)
    want = intervals.build(df.where(F.col("pt") <= numbers[32][1]), racks.INTERVAL_COLUMNS)
    assert rows_of(grown.select(want.columns)) == rows_of(want)
    # an empty day ends all runs; the first day begins them
    ended = intervals.add_day(want, df.limit(0), racks.INTERVAL_COLUMNS, 33, "20990101")
    assert rows_of(ended.select(want.columns)) == rows_of(want)
    first = intervals.add_day(want.limit(0), df.where(F.col("pt") == numbers[0][1]), racks.INTERVAL_COLUMNS, 0, numbers[0][1])
    assert first.count() == df.where(F.col("pt") == numbers[0][1]).count()


def test_intervals_hold_every_day_once(kept):
    df, days, whole = kept
    back = whole.join(days, F.col("day_no").between(F.col("first_no"), F.col("last_no"))).select(df.columns)
    assert rows_of(back) == rows_of(df)
    assert whole.count() < df.count() / 2


@pytest.mark.parametrize("first, last", [("20171101", "20171231"), ("20171110", "20171205"), ("20171105", "20171105"), ("20180101", "20180201")])
def test_online_days_from_intervals(spark, kept, first, last):
    df, days, whole = kept
    cat = catalog(spark)
    cat._loaders["rack"] = lambda: df
    want = racks.online_days(cat, first, last)
    got = racks.online_days_from(whole, days, first, last)
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_daily_counts_and_listed_days_from_intervals(spark, kept):
    df, days, whole = kept
    orders = [order(i, i, 1, f"2017-11-{d:02d} 10:00:00", 5, 4) for i, d in enumerate(range(1, 29))]
    cat = catalog(spark, rack_order=orders)
    cat._loaders["rack"] = lambda: df
    cat._loaders["rack_grade"] = lambda: df.select("machine_id", F.col("machine_name").alias("machine_grading"), "pt")
    want = racks.daily_online_vs_active(cat, AS_OF)
    got = racks.daily_online_vs_active_from(cat, AS_OF, whole, days)
    assert rows_of(got.select(want.columns)) == rows_of(want) and want.count() > 20
    pts = ("20171103", "20171105", "20171109", "20171210", "20300101")  # the second has no snapshot
    want = racks.grade_counts(cat, pts)
    grades = intervals.build(cat.table("rack_grade"), ["machine_id", "machine_grading"])
    got = racks.grade_counts_from(grades, days, pts)
    assert rows_of(got.select(want.columns)) == rows_of(want) and want.count() > 3


# ---- first-seen tables

def test_first_seen_grows_by_new_ids_only(spark, scratch):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), f"2017-11-{d:02d}", i) for i, d in enumerate(sorted(rng.randrange(1, 29) for _ in range(400)))]
    df = spark.createDataFrame(rows, "user_id long, day string, order_id long").cache()
    kept = FirstSeen("firsts", scratch, "user_id", ["day", "order_id"])
    for first, last in (("2017-11-01", "2017-11-09"), ("2017-11-10", "2017-11-10"), ("2017-11-11", "2017-11-30")):
        for _ in range(2):  # a load that is repeated changes nothing
            kept.add(df.where(F.col("day").between(first, last)), last)
    whole = df.groupBy("user_id").agg(F.min(F.struct("day", "order_id")).alias("x")).select("user_id", "x.*")
    assert rows_of(kept.table(spark).select("user_id", "day", "order_id")) == rows_of(whole)
    seen = {r.period: r.n for r in kept.per_period(spark, F.col("day"), "n").collect()}
    assert sum(seen.values()) == whole.where("user_id is not null").count()


# ---- layouts

def test_work_days_prune_the_folders_of_facts_stored_by_day(spark, scratch):
    orders = [order(i, i % 7, i % 3, f"2017-11-{i % 30 + 1:02d} 1{i % 10}:00:00", 5, 4) for i in range(200)]
    cat = catalog(spark, rack_order=orders, rack=[rack(1, "R", 1)])
    daily = by_day(cat, scratch, ["rack_order"])
    for fn in (lambda c: sales.workday_orders(c, AS_OF, "2017-01-01 00:00:00"), lambda c: sales.workday_month(c, AS_OF),
               lambda c: sales.workday_orders_per_rack(c, AS_OF, "2017-01-01 00:00:00"), lambda c: sales.workday_active_racks(c, AS_OF)):
        p = plan(fn(daily))
        scan = next(x for x in p.split("\n") if "FileScan parquet" in x and "rack_order" in x)
        assert "dynamicpruning" in scan and "date_format" not in p
        assert rows_of(fn(daily)) == rows_of(fn(cat))


def test_reports_on_facts_stored_by_order_shuffle_no_fact(spark):
    cat = registry.catalog_for(spark, SF001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = by_order(cat, 4)
        for fn in (lambda c: reports.discounted_order_items(c, registry.A, "06"), lambda c: marketing.coupon_vs_gmv(c, registry.A)):
            assert rows_of(fn(stored)) == rows_of(fn(cat))
            p = plan(fn(stored))
            assert "SortMergeJoin" in p
            joins = p[p.index("SortMergeJoin"):]
            assert "Exchange" not in joins, joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
