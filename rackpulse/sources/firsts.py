"""First-seen tables: each id's first row, kept from load to load.

``first_per_key`` over all history gives an id's first row by reading everything. Kept as a table, a load of later rows only adds
the ids that it does not hold yet: the load's own firsts, less the known ids (an anti join), are appended as
partitions of their own. Cumulative counts then read one row per id, never the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.operators.common import first_per_key
from rackpulse.sources.sinks import materialise, read_materialised


def firsts(rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(key, *order, *keep): each key's first row by ``order``; null is a key like any other (counts of keys leave it out)."""
    return first_per_key(rows, key, list(order), list(keep))


def new_firsts(known: DataFrame, rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The first rows of those keys of ``rows`` (all later than what made ``known``) that ``known`` lacks."""
    old = known.select(F.col(key).alias("_known"))
    return firsts(rows, key, order, keep).join(old, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


class FirstSeen:
    """A stored first-seen table, a partition per load (named by ``load``, which must ascend)."""

    def __init__(self, name: str, root: str, key: str, order: Sequence[str], keep: Sequence[str] = ()) -> None:
        self.name, self.root, self.key, self.order, self.keep = name, root, key, tuple(order), tuple(keep)
        self.path: str | None = None

    def table(self, spark) -> DataFrame:
        return read_materialised(spark, self.path).drop("load")

    def add(self, rows: DataFrame, load: str) -> None:
        """Add a load. Adding the same load again gives the same table: what it had added before is not counted as known."""
        spark = rows.sparkSession
        if self.path is None:
            new = firsts(rows, self.key, self.order, self.keep)
        else:
            known = read_materialised(spark, self.path).where(F.col("load") < load)
            new = new_firsts(known, rows, self.key, self.order, self.keep)
        self.path = materialise(new.withColumn("load", F.lit(load)), self.name, self.root, partition_by="load")

    def per_period(self, spark, period: Column, out: str) -> DataFrame:
        """(period, out): keys first seen in each period."""
        return self.table(spark).groupBy(period.alias("period")).agg(F.count(self.key).alias(out))
