"""Plan shape of every registered report, from Spark's initial physical plan (before AQE re-planning).

    python -m rackpulse.plans.shape /path/to/stored/tables > PLANS.md

Counts shuffles (``Exchange hashpartitioning``/``rangepartitioning``/``SinglePartition``), broadcasts,
join kinds, windows, ``Expand`` (multi-distinct) and reports whether filters reached the scans.
"""

from __future__ import annotations

import re
import sys

from rackpulse.plans import registry
from rackpulse.session import build_session
from rackpulse.sources.catalog import Catalog
from rackpulse.sources.fixtures import fixture_catalog


def shape(df) -> dict:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    p = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p)),
        "broadcasts": p.count("BroadcastExchange"),
        "bhj": p.count("BroadcastHashJoin"),
        "smj": p.count("SortMergeJoin"),
        "nested_loop": p.count("NestedLoopJoin") + p.count("CartesianProduct"),
        "windows": len(re.findall(r"\bWindow \[", p)) + p.count("WindowGroupLimit"),
        "expand": p.count("Expand ["),
        "single_partition": p.count("SinglePartition"),
        "pruned": bool(re.search(r"PartitionFilters: \[[^\]]*=", p)),
        "pushed": "PushedFilters: [" in p and bool(re.search(r"PushedFilters: \[[^\]]*EqualTo", p)),
        "python": "EvalPython" in p,
    }


def main(root: str) -> None:
    spark = build_session("local[4]", shuffle_partitions=8)
    lazy = fixture_catalog(spark, "/root/testdata/sf0.001")
    cat = Catalog.from_parquet(spark, root, lazy.names())
    print("# Plan shapes\n")
    print("Initial physical plan of each report on stored logical tables (AQE may still turn a sort-merge join "
          "into a broadcast join from run-time sizes). `shuffles` counts exchanges including the single-partition "
          "exchange of a global aggregate or an unpartitioned window; `PartitionFilters` = a snapshot or history key prunes folders; `pushed` = an equality filter (snapshot key, "
          "pay status) reached a parquet scan.\n")
    print("| report | shuffles | broadcasts | BHJ | SMJ | nested loop | windows | expand | PartitionFilters | pushed | python |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    for name in sorted(registry.REPORTS):
        s = shape(registry.REPORTS[name](cat))
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['bhj']} | {s['smj']} | {s['nested_loop']} | "
              f"{s['windows']} | {s['expand']} | {'yes' if s['pruned'] else 'no'} | {'yes' if s['pushed'] else 'no'} | {'yes' if s['python'] else 'no'} |")


if __name__ == "__main__":
    main(sys.argv[1])
