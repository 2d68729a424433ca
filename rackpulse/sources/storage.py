"""Storage layouts of the fact tables that reports profit from: folders per pay day, and buckets by order."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

from rackpulse.functions.dates import day_key
from rackpulse.session import conf_of, shared_dir
from rackpulse.sources.catalog import Catalog, snapshot
from rackpulse.sources.sinks import input_bytes, materialise, read_materialised

FACTS = ("rack_order", "order_item")
ORDER_KEYED = ("rack_order", "order_item", "coupon")
#: Bytes of compressed input per bucket: some 100 MB of shuffled rows of the widest table, which a task sorts without a spill.
BUCKET_BYTES = 16 << 20


def _with(cat: Catalog, tables: dict[str, DataFrame]) -> Catalog:
    """``cat`` with some tables in another layout."""
    loaders = {n: (lambda n=n: cat.table(n)) for n in cat.names()} | {n: (lambda t=t: t) for n, t in tables.items()}
    out = Catalog(cat.spark, loaders)
    out.as_of = getattr(cat, "as_of", None)
    return out


def by_day(cat: Catalog, root: str | None = None, names: Iterable[str] = FACTS, as_of: str | None = None) -> Catalog:
    """The catalog with fact tables (their snapshot ``as_of`` only, if given) stored in a folder per snapshot and pay day
    (``pt=../payday=..``) and the calendar stored.

    Reports take the day from the folder's name instead of formatting each row's time, and a join with days of the calendar
    (work days, a month) is known before the facts are read: the scan skips the other days' folders (dynamic
    partition pruning)."""
    root = root or f"{shared_dir(cat.spark)}/by-day-{uuid.uuid4().hex[:8]}"
    tables = {}
    for n in names:
        df = cat.table(n) if as_of is None else snapshot(cat.table(n), as_of)
        keys = (["pt"] if "pt" in df.columns else []) + ["payday"]
        path = materialise(df.withColumn("payday", day_key("pay_complete_time")), n, root, partition_by=keys)
        tables[n] = read_materialised(cat.spark, path)
    tables["calendar"] = read_materialised(cat.spark, materialise(cat.table("calendar").coalesce(1), "calendar", root))
    return _with(cat, tables)


def buckets_for(cat: Catalog, least: int, names: Iterable[str] = ORDER_KEYED) -> int:
    """The number of buckets for ``by_order``: one per ``BUCKET_BYTES`` of the input of the largest of the tables, so that what a
    task reads, sorts and writes stays the same as the tables grow; ``least`` on small ones, and no more than Spark allows."""
    size = max(input_bytes(cat.table(n)) for n in names)
    return min(max(least, -(-size // BUCKET_BYTES)), int(cat.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def by_order(cat: Catalog, buckets: int, root: str | None = None, names: Iterable[str] = ORDER_KEYED) -> Catalog:
    """The catalog with the order-keyed tables bucketed alike by ``order_id``: joins among them read bucket by bucket, without a
    shuffle. ``buckets_for`` sizes ``buckets`` to the tables."""
    mark = uuid.uuid4().hex[:8]
    root = root or f"{shared_dir(cat.spark)}/by-order-{mark}"
    tables = {}
    for n in names:
        df = cat.table(n)
        stored = f"{n}_by_order_{mark}"
        # shuffled into as many partitions, rows that a join has dealt out by order are in their buckets, and Spark leaves out the
        # shuffle of the finished, wider rows
        with conf_of(cat.spark, {"spark.sql.shuffle.partitions": str(buckets)}):
            materialise(df.repartition(buckets, "order_id"), stored, root, "pt" if "pt" in df.columns else None,
                        (buckets, ["order_id"]))
        tables[n] = cat.spark.table(stored)
    return _with(cat, tables)
