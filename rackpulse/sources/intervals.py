"""Validity intervals kept from daily full snapshots.

A daily snapshot table repeats every entity every day. Kept as intervals, an entity has one row for each run of
consecutive snapshot days on which it had the same attributes: ``first_day`` and ``last_day`` are the days' keys, ``first_no`` and
``last_no`` their numbers (0, 1, .. in the order of the keys), so a snapshot day without the entity ends its run, and a calendar
day without a snapshot doesn't. Counts of days are then overlaps of intervals, whatever the number of snapshots.

``build`` makes the intervals of a snapshot table (bit sets of days), ``add_day`` those after one more day from the
intervals before and that day's snapshot alone; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.functions.bitset import WORD_BITS, bit, has_bit

WORD_DAYS = 1 << WORD_BITS
DAY_NO = "day_no"


def snapshot_days(snapshots: DataFrame, day: str = "pt") -> DataFrame:
    """(day, day_no): the snapshot days, numbered. One row a day, so the window without a partition key stays small."""
    days = snapshots.select(day).where(F.col(day).isNotNull()).distinct()
    return days.withColumn(DAY_NO, F.row_number().over(Window.orderBy(day)).cast("int") - 1)


def build(snapshots: DataFrame, attributes: Sequence[str], day: str = "pt", days: DataFrame | None = None) -> DataFrame:
    """(*attributes, first_no, last_no, first_day, last_day) of all runs. Rows that repeat an entity's attributes on a day
    count once.

    An attribute row's days are words of 64 days, a bit each, merged map-side, so what is shuffled and sorted is words, never a row per
    day. A run begins at a bit whose day before is not set and ends at one whose day after is not, both in the same
    word or in a later one: a window sees an entity's words."""
    days = snapshot_days(snapshots, day) if days is None else days
    number, low = F.col(DAY_NO), F.col("_word") * WORD_DAYS
    words = (snapshots.select(*attributes, day).join(days, day)
             .groupBy(*attributes, F.shiftright(number, WORD_BITS).alias("_word"))
             .agg(F.bit_or(bit(number.bitwiseAND(F.lit(WORD_DAYS - 1)))).alias("_bits")))
    by_word = Window.partitionBy(*attributes).orderBy("_word")
    # the last day of the word before and the first of the word after, 1 if set
    before = F.when(F.lag("_word").over(by_word) == F.col("_word") - 1, F.shiftrightunsigned(F.lag("_bits").over(by_word), WORD_DAYS - 1))
    after = F.when(F.lead("_word").over(by_word) == F.col("_word") + 1, F.lead("_bits").over(by_word).bitwiseAND(F.lit(1).cast("long")))
    bits, none = F.col("_bits"), F.lit(0).cast("long")
    earlier = F.shiftleft(bits, 1).bitwiseOR(F.coalesce(before, none))
    later = F.shiftrightunsigned(bits, 1).bitwiseOR(F.shiftleft(F.coalesce(after, none), WORD_DAYS - 1))
    edges = words.select(*attributes, "_word", bits.bitwiseAND(F.bitwise_not(earlier)).alias("_first"),
                         bits.bitwiseAND(F.bitwise_not(later)).alias("_last"))
    edges = edges.where("_first <> 0 OR _last <> 0").select(
        *attributes, "_word", *[F.transform(_set_bits(c), lambda i: i + low).alias(c) for c in ("_first", "_last")])
    # a run that is open at its word's end: the next end of the entity
    next_end = F.first(F.when(F.size("_last") > 0, F.col("_last")[0]), ignorenulls=True).over(
        by_word.rowsBetween(1, Window.unboundedFollowing))
    ends = F.filter("_last", lambda e: (F.size("_first") > 0) & (e >= F.col("_first")[0]))
    ends = F.when(F.size(ends) < F.size("_first"), F.concat(ends, F.array("_next"))).otherwise(ends)
    runs = edges.withColumn("_next", next_end).where(F.size("_first") > 0).select(
        *attributes, F.explode(F.arrays_zip(F.col("_first").alias("first_no"), ends.alias("last_no"))).alias("_run"))
    runs = runs.select(*attributes, F.col("_run.first_no").alias("first_no"), F.col("_run.last_no").alias("last_no"))
    for end in ("first", "last"):
        runs = runs.join(days.select(F.col(DAY_NO).alias(f"{end}_no"), F.col(day).alias(f"{end}_day")), f"{end}_no")
    return runs.select(*attributes, "first_no", "last_no", "first_day", "last_day")


def _set_bits(word: str) -> Column:
    """The places of the bits that are set in a word, ascending."""
    places = F.sequence(F.lit(0), F.lit(WORD_DAYS - 1))
    return F.filter(places, lambda i: has_bit(F.col(word), i))


def add_day(intervals: DataFrame, snapshot: DataFrame, attributes: Sequence[str], day_no: int, day: str) -> DataFrame:
    """The intervals after the snapshot of ``day``, whose number ``day_no`` follows the last one in ``intervals``.

    Runs that reached the day before meet the snapshot on all attributes: those found are longer by a day, the others have
    ended; what the snapshot alone has begins. Ended runs pass through untouched, so a stored table needs only its
    open part rewritten."""
    now = snapshot.select(*attributes).distinct().withColumn("_now", F.lit(True))
    ended, open_ = (intervals.where(c) for c in (F.col("last_no") != day_no - 1, F.col("last_no") == day_no - 1))
    a, b = open_.alias("a"), now.alias("b")
    same = F.col(f"a.{attributes[0]}").eqNullSafe(F.col(f"b.{attributes[0]}"))
    for c in attributes[1:]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = a.join(b, same, "full")
    found = F.col("b._now").isNotNull()

    def either(c):
        return F.when(found, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    live = met.select(*[either(c) for c in attributes], F.coalesce("a.first_no", F.lit(day_no)).alias("first_no"),
                      F.when(found, F.lit(day_no)).otherwise(F.col("a.last_no")).alias("last_no"),
                      F.coalesce("a.first_day", F.lit(day)).alias("first_day"),
                      F.when(found, F.lit(day)).otherwise(F.col("a.last_day")).alias("last_day"))
    return ended.select(live.columns).union(live)


def overlap_days(first: Column, last: Column, low: Column, high: Column) -> Column:
    """Days that [first, last] and [low, high] have in common."""
    return F.greatest(F.least(last, high) - F.greatest(first, low) + 1, F.lit(0))


def days_per_period(intervals: DataFrame, days: DataFrame, period: Column, keys: Sequence[str], out: str,
                    counted: Column | None = None) -> DataFrame:
    """(period, *keys, out): snapshot days of each period, of those days that are ``counted`` (a stretch of days), that the
    intervals cover. ``days`` are all ``snapshot_days``; ``period`` is a function of the day that ascends with it.

    A period is a stretch of day numbers: an interval becomes a row per period from that of its first day to that of
    its last, not a row per day. Intervals of one key must not overlap (an entity has one row a day)."""
    numbered = days.withColumn("period", period)
    number = F.dense_rank().over(Window.orderBy("period"))
    place = numbered.select(DAY_NO, number.alias("period_no"))
    stretch = numbered.withColumn("period_no", number)
    stretch = (stretch if counted is None else stretch.where(counted)).groupBy("period_no", "period").agg(
        F.min(DAY_NO).alias("low"), F.max(DAY_NO).alias("high"))
    first, last = place.toDF("first_no", "_from"), place.toDF("last_no", "_to")
    touched = intervals.select(*keys, "first_no", "last_no").join(first, "first_no").join(last, "last_no")
    touched = touched.withColumn("period_no", F.explode(F.sequence("_from", "_to"))).join(stretch, "period_no")
    covered = overlap_days(F.col("first_no"), F.col("last_no"), F.col("low"), F.col("high"))
    return touched.groupBy("period", *keys).agg(F.sum(covered).cast("long").alias(out)).where(F.col(out) > 0)


def covered_per_day(intervals: DataFrame, days: DataFrame, out: str, day: str = "pt") -> DataFrame:
    """(day, out): how many intervals cover each day that any covers: the running sum of what begins and ends, over one row a
    day."""
    steps = intervals.select(F.col("first_no").alias(DAY_NO), F.lit(1).alias("_n")).union(
        intervals.select((F.col("last_no") + 1).alias(DAY_NO), F.lit(-1))).groupBy(DAY_NO).agg(F.sum("_n").alias("_n"))
    run = F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy(DAY_NO).rowsBetween(Window.unboundedPreceding, 0))
    return days.select(DAY_NO, day).join(steps, DAY_NO, "left").select(day, run.cast("long").alias(out)).where(F.col(out) > 0)


def valid_on(intervals: DataFrame, days: DataFrame, listed: Sequence[str], day: str = "pt") -> DataFrame:
    """The intervals' attributes on each snapshot day of the few ``listed``, with the day as ``day``."""
    inside = F.filter(F.array(*[F.lit(str(d)) for d in sorted(set(listed))]),
                      lambda d: (d >= F.col("first_day")) & (d <= F.col("last_day")))
    rows = intervals.withColumn(day, F.explode(inside)).drop("first_no", "last_no", "first_day", "last_day")
    return rows.join(days.select(day), day, "left_semi")
