"""Reports on kept tables: rebuilt derived tables, intervals, first-seen tables, and facts stored by day or by order.

Each function brings the catalog's tables into that form (as a nightly job does) and runs the report on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.operators import marketing, racks, reports, users
from rackpulse.operators.common import paid_orders
from rackpulse.operators.derived import DERIVED, rebuild_derived_tables
from rackpulse.session import conf_of, shared_dir
from rackpulse.sources import intervals
from rackpulse.sources.catalog import Catalog, snapshot
from rackpulse.sources.firsts import FirstSeen
from rackpulse.sources.sinks import counted, drop, input_bytes, read_materialised, stored

#: Snapshot days that are added one by one to the intervals of the days before them.
LATEST_DAYS = 2
#: Bytes of compressed rows that a task of the interval jobs takes: a byte of daily snapshots becomes some 15 bytes in memory.
TASK_BYTES = 16 << 20


def _fresh_root(cat: Catalog, name: str) -> str:
    return f"{shared_dir(cat.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


# ---- derived tables

def derived_tables(cat: Catalog, as_of: str) -> dict[str, DataFrame]:
    """The derived tables dropped, rebuilt and read back (as the source's nightly script does)."""
    root = _fresh_root(cat, "derived")
    for name in DERIVED:
        drop(cat.spark, name, root)
    return {n: read_materialised(cat.spark, p) for n, p in rebuild_derived_tables(cat, as_of, root).items()}


def derived_table_rows(cat: Catalog, as_of: str) -> DataFrame:
    """Rows of each derived table after a rebuild."""
    return counted(derived_tables(cat, as_of))


def repeat_rate_stored(cat: Catalog, as_of: str) -> DataFrame:
    """The repeat rate, read from the stored weekly cohort."""
    root = _fresh_root(cat, "derived")
    path = rebuild_derived_tables(cat, as_of, root, ["weekly_cohort"])["weekly_cohort"]
    return users.repeat_rate(read_materialised(cat.spark, path))


# ---- daily snapshots as intervals

def kept_intervals(cat: Catalog, table: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """The intervals of a daily snapshot table and its snapshot days: built from history, then continued day by day."""
    snapshots = cat.table(table)
    with conf_of(cat.spark, _small_tasks(cat, snapshots)):
        days = stored(intervals.snapshot_days(snapshots), f"{table}_days")
        latest = sorted((r[intervals.DAY_NO], r.pt) for r in days.orderBy(F.desc(intervals.DAY_NO)).limit(LATEST_DAYS).collect())
        history = snapshots.where(F.col("pt") < latest[0][1]) if latest else snapshots
        kept = stored(intervals.build(history, attributes, days=days), f"{table}_intervals")
        for number, pt in latest:
            kept = stored(intervals.add_day(kept, snapshot(snapshots, pt), attributes, number, pt), f"{table}_intervals")
    return kept, days


def _small_tasks(cat: Catalog, rows: DataFrame) -> dict[str, str]:
    """Settings under which a task's share stays the same as the tables grow: partitions by the input's size, and put together only
    up to ``TASK_BYTES``."""
    parts = max(int(cat.spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(rows) // TASK_BYTES))
    return {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{TASK_BYTES}b"}


def top_racks_online_days(cat: Catalog, as_of: str, since_day: str, first_pt: str, last_pt: str, n: int) -> DataFrame:
    kept, days = kept_intervals(cat, "rack", racks.INTERVAL_COLUMNS)
    online = racks.online_days_from(kept, days, first_pt, last_pt)
    return reports.top_racks_online_days(cat, as_of, since_day, first_pt, last_pt, n, online=online)


def daily_online_vs_active(cat: Catalog, as_of: str) -> DataFrame:
    return racks.daily_online_vs_active_from(cat, as_of, *kept_intervals(cat, "rack", racks.INTERVAL_COLUMNS))


def grade_counts(cat: Catalog, pts) -> DataFrame:
    return racks.grade_counts_from(*kept_intervals(cat, "rack_grade", ["machine_id", "machine_grading"]), pts)


# ---- first orders

def first_orders(cat: Catalog, as_of: str) -> FirstSeen:
    """Each buyer's first paid order, kept up year by year."""
    kept = FirstSeen("first_orders", _fresh_root(cat, "firsts"), "user_id", ["pay_complete_time", "order_id"],
                     ["origin_amount", "actual_amount"])
    orders = paid_orders(cat, as_of)
    for (year,) in sorted(orders.select(F.year("pay_complete_time")).where("pay_complete_time is not null").distinct().collect()):
        kept.add(orders.where(F.year("pay_complete_time") == year), f"{year:04d}")
    return kept


def cumulative_buyers(cat: Catalog, as_of: str) -> DataFrame:
    kept = first_orders(cat, as_of)
    return users.cumulative_buyers_from(cat, as_of, kept.table(cat.spark))


def acquisition_cost(cat: Catalog, as_of: str) -> DataFrame:
    return marketing.acquisition_cost(cat, as_of, firsts=first_orders(cat, as_of).table(cat.spark))
