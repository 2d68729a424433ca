"""Benchmark: warm median of 3 runs of every report on $BENCH_SF_DIR, local[$BENCH_CPUS] (report names as arguments
for some of them). ``value`` is the sum over the reports; ``load_sec``, the writing of the logical tables they
read, and ``total_with_load_sec`` stand beside it.

Each run executes the whole plan into Spark's ``noop`` sink (no collect to the driver). Prints one
the constant-key triangular join of the source versus first-seen + running sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rackpulse.functions.dates import month_key  # noqa: E402
from rackpulse.operators.common import paid_orders  # noqa: E402
from rackpulse.plans import registry  # noqa: E402
from rackpulse.session import build_session, checkpoint_dir  # noqa: E402
from rackpulse.sources.fixtures import AS_OF, materialise_catalog  # noqa: E402

HEADLINE = [
    "rack_master_report", "daily_kpis", "weekly_kpis", "workday_month", "sku_share", "sku_monthly_reach",
    "top_racks_online_days", "rack_month_profit", "cumulative_buyers", "cumulative_buyers_range",
    "weekly_cohort", "repeat_rate", "coupon_vs_gmv", "acquisition_cost", "band_monthly_sales",
    "order_detail", "turnover_days", "company_band",
]


def triangular_buyers(cat):
    """The source's formulation: (month, user) pairs joined to every pair of an earlier month."""
    um = (paid_orders(cat, AS_OF).select(month_key("pay_complete_time").alias("month"), "user_id")
          .distinct().withColumn("key", F.lit(1)))
    a, b = um.alias("a"), um.alias("b")
    return (a.join(b, "key").where(F.col("a.month") >= F.col("b.month"))
            .groupBy(F.col("a.month").alias("month")).agg(F.countDistinct("b.user_id").alias("user_qyt")))


def skewed_catalog(cat, root):
    """The stored order tables with a third of the orders moved onto one rack, one buyer and one day
    (the skew the reports must survive); written next to the originals, other tables shared."""
    from rackpulse.sources.catalog import Catalog
    from rackpulse.sources.sinks import materialise
    hot = (F.col("order_id") % 3) == 0
    day = F.lit("2000-01-03 00:00:00").cast("timestamp_ntz")
    moved = {}
    for name in ("rack_order", "order_item"):
        df = cat.table(name)
        df = (df.withColumn("machine_id", F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("machine_id")))
                .withColumn("user_id", F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("user_id")))
                .withColumn("pay_complete_time", F.when(hot, day).otherwise(F.col("pay_complete_time"))))
        moved[name] = materialise(df, name, root)
    loaders = {n: (lambda n=n: cat.table(n)) for n in cat.names()}
    for n, pth in moved.items():
        loaders[n] = (lambda pth=pth: cat.spark.read.parquet(pth))
    out = Catalog(cat.spark, loaders)
    out.as_of = AS_OF
    return out


SKEW_REPORTS = ["daily_kpis", "workday_month", "rack_month_pivot", "acquisition_cost", "sku_share",
                "top_racks_sold_days", "rack_month_profit", "coupon_vs_gmv", "band_users"]


def timed(df, runs=3):
    times = []
    for _ in range(runs + 1):  # first run warms caches / JIT and is dropped
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - t0)
    return statistics.median(times[1:])


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or sorted(registry.REPORTS)
    spark = build_session(f"local[{cpus}]", "rackpulse-bench", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                          extra={"spark.driver.memory": "16g"})
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        checkpoint_dir(spark, tempfile.mkdtemp(prefix="rackpulse-ckpt-"))   # local runs only
    root = checkpoint_dir(spark)
    t0 = time.perf_counter()
    cat = materialise_catalog(spark, sf_dir, f"{root.rstrip('/')}/warehouse-{os.getpid()}")
    load = time.perf_counter() - t0
    # let the freshly written files reach the disk and touch every table once, so the first timed
    # report does not pay for the load's write-back and JVM warm-up
    os.sync()
    for name in cat.names():
        cat.table(name).write.format("noop").mode("overwrite").save()
    out = {}
    for name in names:
        out[name] = round(timed(registry.REPORTS[name](cat)), 3)
        print(f"{name}: {out[name]}s", file=sys.stderr, flush=True)
    skew = {}
    if os.environ.get("BENCH_SKEW"):
        sk = skewed_catalog(cat, f"{root.rstrip('/')}/warehouse-skew-{os.getpid()}")
        for name in SKEW_REPORTS:
            base, hot = registry.REPORTS[name](cat), registry.REPORTS[name](sk)
            skew[name] = {"base": round(timed(base, runs=1), 3), "skewed": round(timed(hot, runs=1), 3)}
            print(f"skew {name}: {skew[name]}", file=sys.stderr, flush=True)
        from rackpulse.operators.sales import daily_kpis
        every = "1900-01-01 00:00:00"   # moved orders keep their count: compare over all days
        skew["orders_preserved"] = (daily_kpis(cat, AS_OF, every).agg(F.sum("order_qyt")).first()[0]
                                    == daily_kpis(sk, AS_OF, every).agg(F.sum("order_qyt")).first()[0])
    # the quadratic formulation is timed on the smaller fixture (at sf0.1 it runs for many minutes)
    small_dir = os.environ.get("BENCH_COMPARE_DIR", "/root/testdata/sf0.01")
    small = registry.catalog_for(spark, small_dir)
    from rackpulse.operators.users import cumulative_buyers
    extra = {"sf": os.path.basename(small_dir.rstrip("/")).replace("sf", ""),
             "cumulative_buyers_triangular": round(timed(triangular_buyers(small), runs=1), 3),
             "cumulative_buyers_first_seen": round(timed(cumulative_buyers(small, AS_OF), runs=1), 3)}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "load_sec": round(load, 3),
                      "total_with_load_sec": round(sum(out.values()) + load, 3), "headline_sec": round(sum(out.get(n, 0) for n in HEADLINE), 3), "comparison": extra, **({"skew": skew} if skew else {}), "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
