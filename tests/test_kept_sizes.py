"""Kept tables on larger inputs: what a task reads, sorts or keeps must not follow the size of the tables."""

import random
import re

from rackpulse.operators import racks, reports
from rackpulse.plans import kept, registry
from rackpulse.session import conf_of
from rackpulse.sources import intervals, storage
from rackpulse.sources.sinks import input_bytes
from rackpulse.sources.storage import ORDER_KEYED, by_order, buckets_for
from tests.conftest import SF001, SF01
from tests.test_kept import rows_of
from tests.test_plans import plan


def test_buckets_follow_the_input(spark, monkeypatch):
    small, large = (registry.catalog_for(spark, d) for d in (SF001, SF01))
    assert input_bytes(large.table("order_item")) > 5 * input_bytes(small.table("order_item")) > 0
    assert input_bytes(spark.createDataFrame([(1,)], "a int")) == 0
    assert buckets_for(small, registry.BUCKETS) == registry.BUCKETS
    monkeypatch.setattr(storage, "BUCKET_BYTES", 50_000)
    few, many = buckets_for(small, 2), buckets_for(large, 2)
    assert few >= 2 and many > 5 * few
    stored = registry._by_order(large)
    assert registry.BUCKETS < many
    for name in ORDER_KEYED:
        scan = next(x for x in plan(stored.table(name)).split("\n") if "FileScan" in x)
        assert f"SelectedBucketsCount: {many} out of {many}" in scan or "Bucketed: false" in scan
        ids = {int(re.search(r"_(\d{5})\.c000", f).group(1)) for f in stored.table(name).inputFiles()}
        assert len(ids) == many and max(ids) == many - 1


def test_facts_by_order_are_shuffled_once(spark):
    cat = registry.catalog_for(spark, SF001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # orders and lines are large, racks and parts are not
    try:
        for name in ("rack_order", "order_item"):
            p = plan(cat.table(name).repartition(8, "order_id"))
            assert "SortMergeJoin" in p
            keys = set(re.findall(r"Exchange hashpartitioning\((\w+)#", p))
            assert "REPARTITION_BY_NUM" not in p and keys == {"l_orderkey", "o_orderkey"}, p
        before = spark.conf.get("spark.sql.shuffle.partitions")
        stored = by_order(cat, 11)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        for name in ORDER_KEYED:
            assert rows_of(stored.table(name).select(cat.table(name).columns)) == rows_of(cat.table(name))
        p = plan(reports.order_detail(stored, registry.A, registry.NAMED_RACKS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the racks of the list go to the lines, the lines to the orders of their bucket
    assert not re.search(r"Exchange hashpartitioning\(machine_id#\d+L?, \d+\)[^\n]*\n[^\n]*\n?[^\n]*FileScan parquet [^\n]*order_item", p), p


def runs_of(days):
    """(first, last) of the stretches of consecutive numbers."""
    out = []
    for d in sorted(set(days)):
        if out and out[-1][1] == d - 1:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


def test_runs_cross_words_of_days(spark):
    rng = random.Random(3)
    held = {"always": range(330), "no day": (), "one": [64], "edges": [0, 63, 64, 127, 128, 191, 329], "whole words": range(64, 192),
            "to a word's end": range(10, 64), "from a word's start": range(128, 200), "odd": range(1, 330, 2), None: range(60, 260),
            "far apart": [5, 6, 310, 311], "over an edge": [62, 63, 64, 65, 70, 126, 127, 128]}
    for i in range(60):
        share = rng.random() ** 2
        days, on = [], True
        for d in range(330):
            on = (not on) if rng.random() < share else on
            days += [d] * on
        held[f"random {i}"] = days
    rows = [(k, f"d{d:04d}") for k, days in held.items() for d in days for _ in range(rng.choice([1, 1, 3]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, pt string")
    got = intervals.build(df, ["name"])
    want = [(k, a, b, f"d{a:04d}", f"d{b:04d}") for k, days in held.items() for a, b in runs_of(days)]
    assert got.columns == ["name", "first_no", "last_no", "first_day", "last_day"]
    assert rows_of(got) == sorted(want, key=repr)
    assert intervals.build(df.limit(0), ["name"]).collect() == []


def test_intervals_sort_words_not_a_row_per_day(spark):
    cat = registry.catalog_for(spark, SF001)
    p = plan(intervals.build(cat.table("rack"), racks.INTERVAL_COLUMNS))
    window = p[p.index("Window"):]
    assert "SortAggregate" not in p and "partial_bit_or" in window and "_word" in window.split("\n")[0], p


def test_tasks_of_the_interval_jobs_follow_the_input(spark, monkeypatch):
    cat = registry.catalog_for(spark, SF01)
    size = input_bytes(cat.table("rack_grade"))
    monkeypatch.setattr(kept, "TASK_BYTES", 50_000)
    seen, keys = [], ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    monkeypatch.setattr(kept, "stored", lambda df, name: seen.append([spark.conf.get(k) for k in keys]) or df)
    before = [spark.conf.get(k) for k in keys]
    kept.kept_intervals(cat, "rack_grade", ["machine_id", "machine_grading"])
    assert len(seen) == 2 + kept.LATEST_DAYS and set(map(tuple, seen)) == {(str(-(-size // 50_000)), "50000b")} and size > 20 * 50_000
    assert [spark.conf.get(k) for k in keys] == before
    try:
        with conf_of(spark, {keys[0]: "3"}):
            raise KeyError
    except KeyError:
        assert [spark.conf.get(k) for k in keys] == before
