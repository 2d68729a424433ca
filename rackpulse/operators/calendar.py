"""Work-day calendar dimension and the work-day filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.dates import day_key, iso_week, iso_year, monday

# ---- fixed values: calendar labels ----
WORKDAY = "工作日"   # day_type of a work day
RESTDAY = "休息日"   # day_type of a weekend day
YEAR_SUFFIX = "年"
WEEK_SUFFIX = "周"
# ---- end of fixed values ----


def calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """One row per day in ``[start, end]`` (ISO dates).

    ``day_type`` is a work day Monday..Friday unless ``holidays`` (``day_id``, ``day_type``) overrides
    it (of several entries for a day, the one that makes it a rest day counts). ``year_name_cn`` is the ISO week-numbering year, so ``year_name_cn || week_of_year`` names
    one ISO week even across New Year.
    """
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day_date"))
    cal = days.select(
        day_key("day_date").alias("day_id"),
        F.when(F.weekday("day_date") < 5, F.lit(WORKDAY)).otherwise(F.lit(RESTDAY)).alias("day_type"),
        monday("day_date").alias("monday_date"),
        F.concat(iso_year("day_date").cast("string"), F.lit(YEAR_SUFFIX)).alias("year_name_cn"),
        iso_week("day_date").alias("week_of_year"),
        F.month("day_date").alias("month_short_id"),
        F.date_format("day_date", "yyyyMM").alias("month_id"),
        F.year("day_date").alias("year_id"),
        "day_date",
    )
    if holidays is not None:
        rest = F.min(F.struct(F.col("day_type") == WORKDAY, "day_type"))
        h = holidays.where(F.col("day_type").isNotNull()).groupBy("day_id").agg(rest["day_type"].alias("_override"))
        cal = (cal.join(h, "day_id", "left")
               .withColumn("day_type", F.coalesce("_override", "day_type")).drop("_override"))
    return cal


def workdays_only(df: DataFrame, cal: DataFrame, day_col: str = "payday") -> DataFrame:
    """Keep rows whose ``day_col`` (``yyyyMMdd``) is a work day: a semi join, no calendar columns."""
    work = cal.where(F.col("day_type") == WORKDAY).select(F.col("day_id").alias(day_col))
    return df.join(work, day_col, "left_semi")
