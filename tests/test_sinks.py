"""Sink and session helpers."""

import os

import pytest
from pyspark.sql import functions as F

from rackpulse.session import checkpoint_dir
from rackpulse.sources.catalog import Catalog, snapshot_in, snapshot_range
from rackpulse.sources import sinks
from rackpulse.sources.sinks import materialise, read_materialised


def test_materialise_overwrites_and_partitions(spark, scratch):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).cast("string").alias("pt"))
    p1 = materialise(df, "t", scratch, partition_by="pt")
    p2 = materialise(df, "t", scratch, partition_by="pt")   # rebuild: same content, no duplicates
    assert p1 == p2 and sorted(os.listdir(p1))[-2:] == ["pt=0", "pt=1"]
    back = read_materialised(spark, p1)
    assert back.count() == 10 and dict(back.dtypes)["pt"] == "string"


def test_one_day_is_rebuilt_beside_the_others(spark, scratch):
    day = lambda pt, n: spark.range(n).select("id", F.lit(pt).alias("pt"))
    materialise(day("20171130", 3), "days", scratch, partition_by="pt")
    materialise(day("20171201", 2), "days", scratch, partition_by="pt")
    path = materialise(day("20171201", 5), "days", scratch, partition_by="pt")
    got = {r.pt: r["count"] for r in read_materialised(spark, path).groupBy("pt").count().collect()}
    assert got == {"20171130": 3, "20171201": 5}


def test_failed_rebuild_leaves_the_old_table(spark, scratch):
    path = materialise(spark.range(4), "kept", scratch)
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    try:
        materialise(broken, "kept", scratch)
        raise AssertionError("the rebuild should fail")
    except Exception as e:  # noqa: BLE001
        assert "broken" in str(e)
    assert spark.read.parquet(path).count() == 4


def test_partition_keys_are_strings_in_a_default_session(spark, scratch):
    df = spark.createDataFrame([(1, "20171130")], "machine_id long, pt string")
    materialise(df, "rack", scratch, partition_by="pt")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    try:
        assert dict(Catalog.from_parquet(spark, scratch, ["rack"])["rack"].dtypes)["pt"] == "string"
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")


def test_default_root_is_the_checkpoint_dir(spark):
    df = spark.range(3)
    path = materialise(df, "ckpt_table")
    assert path.startswith(checkpoint_dir(spark).rstrip("/")) and spark.read.parquet(path).count() == 3


def test_catalog_from_parquet_and_snapshot_filters(spark, scratch):
    df = spark.createDataFrame([(1, "20171130"), (2, "20171201"), (3, "20171231")], "machine_id long, pt string")
    materialise(df, "rack", scratch, partition_by="pt")
    cat = Catalog.from_parquet(spark, scratch, ["rack"])
    assert snapshot_range(cat["rack"], "20171201", "20171231").count() == 2
    assert snapshot_in(cat["rack"], ["20171130"]).first().machine_id == 1


def test_rebuild_derived_tables_is_idempotent(spark, scratch):
    from rackpulse.operators.derived import rebuild_derived_tables
    from rackpulse.operators.users import repeat_rate
    from rackpulse.plans import registry
    from rackpulse.sources.fixtures import AS_OF
    from tests.conftest import SF001

    cat = registry.catalog_for(spark, SF001)
    first = rebuild_derived_tables(cat, AS_OF, scratch)
    counts = {n: spark.read.parquet(p).count() for n, p in first.items()}
    again = rebuild_derived_tables(cat, AS_OF, scratch)
    assert first == again and counts == {n: spark.read.parquet(p).count() for n, p in again.items()}
    cohort = spark.read.parquet(first["weekly_cohort"])
    assert repeat_rate(cohort).count() == registry.REPORTS["repeat_rate"](cat).count()


def test_cumulative_distinct_generic(spark):
    from rackpulse.operators.users import cumulative_distinct
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3), ("c", None)], "p string, u long")
    periods = spark.createDataFrame([("0",), ("a",), ("b",), ("c",)], "p string")
    got = sorted(tuple(r) for r in cumulative_distinct(df, "p", "u", periods, "n").collect())
    assert got == [("0", 0), ("a", 2), ("b", 2), ("c", 3)]


def test_catalog_from_tables(spark):
    spark.range(5).createOrReplaceTempView("tiny_source")
    cat = Catalog.from_tables(spark, {"tiny": "tiny_source"})
    assert cat.table("tiny").count() == 5 and cat.names() == ["tiny"]


def test_stored_catalog_gives_the_same_reports(spark, scratch):
    """The bench times reports on the written logical tables; they must equal the lazy view."""
    from rackpulse.plans import registry
    from rackpulse.sources.fixtures import fixture_catalog, materialise_catalog
    from tests.conftest import SF001

    stored = materialise_catalog(spark, SF001, scratch)
    lazy = fixture_catalog(spark, SF001)
    for name in ["rack_master_report", "top_racks_online_days", "weekly_cohort", "new_user_ticket",
                 "avg_full_stock_hist"]:
        a = sorted(map(tuple, registry.REPORTS[name](stored).collect()), key=repr)
        b = sorted(map(tuple, registry.REPORTS[name](lazy).collect()), key=repr)
        assert a == b, name


def test_bucketed_tables_join_without_shuffle(spark, scratch):
    from pyspark.sql import functions as F
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.range(1000).select(F.col("id").alias("order_id"), (F.col("id") % 7).alias("machine_id"))
        coupons = spark.range(3000).select((F.col("id") % 1000).alias("order_id"), F.lit(1.0).alias("discount"))
        materialise(orders, "bk_orders", scratch, bucket_by=(8, ["order_id"]))
        materialise(coupons, "bk_coupons", scratch, bucket_by=(8, ["order_id"]))
        j = spark.table("bk_orders").join(spark.table("bk_coupons"), "order_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_partition_has_many_files(spark, scratch):
    hot = "pt string, id long, noise string"
    df = spark.range(60000).select(F.when(F.col("id") % 20 > 0, "20171201").otherwise(F.concat(F.lit("201711"), F.lpad(
        F.col("id") % 9 + 1, 2, "0"))).alias("pt"), "id", F.sha2(F.col("id").cast("string"), 256).alias("noise"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        path = materialise(df, "hot", scratch, partition_by="pt")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    files = {d: sum(f.endswith(".parquet") for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("pt=")}
    # a small partition that lies in the hot one's shuffle partition is split with it; the others have one writer
    assert files["pt=20171201"] >= 4 and min(files.values()) == 1
    back = read_materialised(spark, path)
    assert back.count() == 60000 and set(back.columns) == {x.split()[0] for x in hot.split(", ")}


@pytest.mark.parametrize("keys", [None, "pt", ["pt", "city"]])
def test_a_failing_move_leaves_the_old_table(spark, scratch, monkeypatch, keys):
    def rows(n):
        return spark.range(n).select("id", F.lit("20171201").alias("pt"), (F.col("id") % 2).cast("string").alias("city"))

    path = materialise(rows(4), "kept", scratch, partition_by=keys)
    real = sinks._move

    def failing(fs, source, target):
        if ".new-" in source.toString():
            raise OSError("no space")
        real(fs, source, target)

    monkeypatch.setattr(sinks, "_move", failing)
    with pytest.raises(OSError, match="no space"):
        materialise(rows(9), "kept", scratch, partition_by=keys)
    assert spark.read.parquet(path).count() == 4
    monkeypatch.setattr(sinks, "_move", real)
    materialise(rows(9), "kept", scratch, partition_by=keys)
    assert spark.read.parquet(path).count() == 9 and not [x for x in os.listdir(scratch) if ".old-" in x]


@pytest.mark.parametrize("keys", [None, "pt"])
def test_a_table_put_aside_by_a_lost_driver_returns(spark, scratch, monkeypatch, keys):
    def rows(n):
        return spark.range(n).select("id", F.lit("20171201").alias("pt"))

    path = materialise(rows(4), "lost", scratch, partition_by=keys)
    real = sinks._move

    def lost(fs, source, target):
        if ".new-" in source.toString() or ".old-" in source.toString():
            raise KeyboardInterrupt
        real(fs, source, target)

    monkeypatch.setattr(sinks, "_move", lost)
    with pytest.raises(KeyboardInterrupt):
        materialise(rows(9), "lost", scratch, partition_by=keys)
    monkeypatch.setattr(sinks, "_move", real)
    assert len(sinks.recover(spark, path)) == 1 and sinks.recover(spark, path) == []
    assert read_materialised(spark, path).count() == 4


def test_drop(spark, scratch):
    path = materialise(spark.range(3), "dropped", scratch)
    assert sinks.drop(spark, "dropped", scratch) and not os.path.exists(path)
    assert not sinks.drop(spark, "dropped", scratch)


def test_a_published_table_is_never_missing(spark, scratch):
    def rows(n):
        return spark.range(n).select("id", F.lit("20171201").alias("pt"))

    first = sinks.publish(rows(3), "published_orders", scratch, "pt")
    reader = spark.table("published_orders")
    second = sinks.publish(rows(5), "published_orders", scratch, "pt")
    assert reader.count() == 3 and spark.table("published_orders").count() == 5
    assert dict(spark.table("published_orders").dtypes)["pt"] == "string"
    with pytest.raises(Exception, match="broken"):
        sinks.publish(rows(5).withColumn("id", F.raise_error(F.lit("broken")).cast("long")), "published_orders", scratch)
    assert spark.table("published_orders").count() == 5
    sinks.publish(rows(6), "published_orders", scratch)
    assert not os.path.exists(first) and os.path.exists(second)
    spark.sql("DROP VIEW published_orders")
