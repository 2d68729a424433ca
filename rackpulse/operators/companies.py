"""Companies hosting racks: headcount parsing, size bands, imputation, and sales by company size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.agg import distinct_count
from rackpulse.functions.dates import MONTH_FMT, day_start, iso_week, iso_year
from rackpulse.functions.headcount import (
    BANDS_COARSE, BANDS_DETAIL, BANDS_FINE, IMPUTE_COARSE, IMPUTE_FINE, band, cut_length,
    impute_headcount, parse_headcount,
)
from rackpulse.functions.ratio import money, ratio
from rackpulse.operators.common import paid_orders, racks_at, with_keys
from rackpulse.sources.catalog import PAID, Catalog, snapshot

ACTIVE = (2, 3)        # fixed value: release_status of racks in service
LISTED = (2, 3, -1)    # fixed value: release_status of racks in the rack list (-1 = withdrawn)


def headcount_length(cat: Catalog) -> DataFrame:
    """Per company: number of headcount characters kept for parsing."""
    return cat.table("company_raw").select("customer_id", cut_length("total_people").alias("leng"))


def headcount_parsed(cat: Catalog) -> DataFrame:
    """Per company: parsed headcount (digits, or ``''`` when there is nothing to parse)."""
    return cat.table("company_raw").select("customer_id", parse_headcount("total_people").alias("total_people"))


def _parsed_with_digits(cat: Catalog) -> DataFrame:
    """Parsed headcount of the companies whose text kept at least one character."""
    r = cat.table("company_raw")
    return (r.where(cut_length("total_people") > 0)
            .select("customer_id", parse_headcount("total_people").alias("parsed")))


def _week(ts: str, week_key: str):
    if week_key == "week":
        return iso_week(ts)
    return iso_year(ts) * 100 + iso_week(ts)


def size_distribution(cat: Catalog, as_of: str, online_from: str, online_to: str) -> DataFrame:
    """Racks put online in ``[online_from, online_to)`` (day keys) and their companies, per coarse
    size band of the parsed headcount."""
    r = racks_at(cat, as_of)
    t = "online_time"
    r = r.where((F.col(t) >= F.lit(day_start(online_from)).cast(r.schema[t].dataType))
                & (F.col(t) < F.lit(day_start(online_to)).cast(r.schema[t].dataType)))
    c = snapshot(cat.table("company"), as_of).select("customer_id", "corp_name")
    j = r.select("machine_id", "customer_id").join(c, "customer_id").join(_parsed_with_digits(cat), "customer_id")
    per_company = (j.groupBy("customer_id", "corp_name", band("parsed", BANDS_COARSE).alias("total_people"))
                   .agg(F.count("machine_id").alias("machine_qyt")))
    return per_company.groupBy("total_people").agg(F.sum("machine_qyt").alias("machine_qyt"),
                                                   F.countDistinct("customer_id").alias("customer_qyt"))


def small_companies(cat: Catalog, as_of: str, below: int = 50, blank: str = " ") -> DataFrame:
    """Companies with fewer than ``below`` people (parsed headcount), plus companies whose raw
    headcount is null or ``blank``, with their number of racks in service."""
    r = racks_at(cat, as_of).where(F.col("release_status").isin(list(ACTIVE))).select("machine_id", "customer_id")
    c = snapshot(cat.table("company"), as_of).select("customer_id", "corp_name")
    small = (r.join(c, "customer_id").join(_parsed_with_digits(cat), "customer_id")
             .where(F.col("parsed").try_cast("double") < below)
             .groupBy("customer_id", "corp_name", F.col("parsed").alias("total_people"))
             .agg(F.count("machine_id").alias("machine_qyt")))
    raw = cat.table("company_raw").where(F.col("total_people").isNull() | (F.col("total_people") == blank))
    unknown = (raw.join(c, "customer_id").join(r, "customer_id")
               .groupBy("customer_id", "corp_name", "total_people")
               .agg(F.count("machine_id").alias("machine_qyt")))
    return small.unionByName(unknown)


def company_weekly_sales(cat: Catalog, as_of: str, week_key: str = "yearweek", status: int = PAID) -> DataFrame:
    """Weekly orders of every rack of the small companies (``small_companies``)."""
    a = small_companies(cat, as_of)
    c = snapshot(cat.table("company"), as_of).select("customer_id")
    m = racks_at(cat, as_of).select("machine_id", "customer_id", "machine_name", "machine_type_name",
                                    "machine_sub_type_name")
    o = (paid_orders(cat, as_of, status)
         .groupBy("city_name", "machine_id", _week("pay_complete_time", week_key).alias("weekno"))
         .agg(F.count("order_id").alias("order_qyt")))
    j = a.join(c, "customer_id").join(m, "customer_id").join(o, "machine_id")
    return j.select("city_name", "customer_id", "corp_name", "total_people", "machine_name", "machine_type_name",
                    "machine_sub_type_name", "weekno", "order_qyt")


def rack_grade_detail(cat: Catalog, as_of: str, week_key: str = "yearweek", status: int = PAID) -> DataFrame:
    """Per rack: city, coarse company size band, grade, sub-type and average weekly orders."""
    d = headcount_parsed(cat)
    c = snapshot(cat.table("company"), as_of).select("customer_id")
    m = racks_at(cat, as_of).select("machine_id", "customer_id", "machine_sub_type_name")
    g = snapshot(cat.table("rack_grade"), as_of).select("machine_id", "machine_grading")
    weekly = (paid_orders(cat, as_of, status)
              .groupBy("city_name", "machine_id", _week("pay_complete_time", week_key).alias("weekno"))
              .agg(F.count("order_id").alias("order_qyt")))
    o = weekly.groupBy("city_name", "machine_id").agg(F.avg("order_qyt").alias("order_qyt"))
    j = d.join(c, "customer_id").join(m, "customer_id").join(g, "machine_id").join(o, "machine_id")
    return j.select("city_name", band("total_people", BANDS_COARSE).alias("total_people"), "machine_id",
                    "machine_grading", "machine_sub_type_name", "order_qyt")


def _sized(cat: Catalog, as_of: str, prefer: str) -> DataFrame:
    """Per company: merged headcount (own text vs parsed, by ``prefer``) and distinct racks that have
    a city."""
    c = snapshot(cat.table("company"), as_of).select("customer_id", "corp_name", F.col("total_people").alias("t1"))
    t = headcount_parsed(cat).withColumnRenamed("total_people", "t2")
    merged = F.coalesce("t1", "t2") if prefer == "own" else F.coalesce("t2", "t1")
    m = racks_at(cat, as_of).where(F.col("city_name").isNotNull()).select("machine_id", "customer_id")
    j = c.join(t, "customer_id").join(m, "customer_id")
    return (j.groupBy("customer_id", "corp_name", merged.alias("total_people"))
            .agg(F.countDistinct("machine_id").alias("machine_qyt")))


def company_size(cat: Catalog, as_of: str, prefer: str = "own", rules=IMPUTE_COARSE,
                 null_as_empty: bool = False, keep_name: bool = False) -> DataFrame:
    """Per company: headcount (own text first by default; missing ones imputed from the rack count)
    and the number of racks."""
    b = _sized(cat, as_of, prefer)
    cols = ["customer_id"] + (["corp_name"] if keep_name else []) + [
        impute_headcount("total_people", "machine_qyt", rules, null_as_empty).alias("total_people"),
        "machine_qyt"]
    return b.select(*cols)


def headcount_detail(cat: Catalog, as_of: str) -> DataFrame:
    """Per company: the imputed headcount (parsed text first, fine imputation rules)."""
    return company_size(cat, as_of, prefer="parsed", rules=IMPUTE_FINE)


def company_band(cat: Catalog, as_of: str) -> DataFrame:
    """Per company: fine size band of the imputed headcount, and the number of racks."""
    d = headcount_detail(cat, as_of)
    return d.select("customer_id", band("total_people", BANDS_FINE).alias("total_people"), "machine_qyt")


def racks_by_band(cat: Catalog, as_of: str) -> DataFrame:
    """Racks in service per fine company size band."""
    d = company_band(cat, as_of).select("customer_id", "total_people")
    m = racks_at(cat, as_of).where(F.col("release_status").isin(list(ACTIVE))).select("machine_id", "customer_id")
    return (m.join(d, "customer_id").groupBy("total_people")
            .agg(F.countDistinct("machine_id").alias("machine_qyt")))


def _detail_band(cat: Catalog, as_of: str) -> DataFrame:
    d = headcount_detail(cat, as_of)
    return d.select("customer_id", band("total_people", BANDS_DETAIL).alias("total_people"))


def active_racks_by_band(cat: Catalog, as_of: str) -> DataFrame:
    """Racks in service per detail size band."""
    m = racks_at(cat, as_of).where(F.col("release_status").isin(list(ACTIVE))).select("machine_id", "customer_id")
    return (m.join(_detail_band(cat, as_of), "customer_id").groupBy("total_people")
            .agg(F.countDistinct("machine_id").alias("machine_qyt")))


def racks_by_band_two_snapshots(cat: Catalog, then: str, now: str, detail_as_of: str) -> DataFrame:
    """Racks in service at snapshot ``then``, placed at their company of snapshot ``now``, per
    detail size band."""
    ids = racks_at(cat, then).where(F.col("release_status").isin(list(ACTIVE))).select("machine_id")
    m = ids.join(racks_at(cat, now).select("machine_id", "customer_id"), "machine_id")
    return (m.join(_detail_band(cat, detail_as_of), "customer_id").groupBy("total_people")
            .agg(F.countDistinct("machine_id").alias("machine_qyt")))


def _banded_racks(cat: Catalog, as_of: str) -> DataFrame:
    """Racks whose company has a detail band (racks without one drop from the inner joins)."""
    return racks_at(cat, as_of).select("machine_id", "customer_id").join(_detail_band(cat, as_of), "customer_id")


def band_orders_gmv(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Per month x detail band: orders and GMV. Orders are rolled up per month x rack before the join."""
    per = (with_keys(paid_orders(cat, as_of, status), month_fmt).groupBy("month", "machine_id")
           .agg(F.count("order_id").alias("order_qyt"), F.sum("origin_amount").alias("GMV")))
    g = per.join(_banded_racks(cat, as_of), "machine_id").groupBy("month", "total_people").agg(
        F.sum("order_qyt").alias("order_qyt"), F.sum("GMV").alias("GMV"))
    return g.select("month", "total_people", "order_qyt", money("GMV").alias("GMV"))


def band_users(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Per month x detail band: distinct users per company, summed over companies. Orders are reduced to
    distinct month x rack x user before the join."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt).select("month", "machine_id", "user_id").distinct()
    per = distinct_count(o.join(_banded_racks(cat, as_of), "machine_id"), ["month", "customer_id", "total_people"],
                         "user_id", "user_qyt")
    return per.groupBy("month", "total_people").agg(F.sum("user_qyt").alias("user_qyt"))


def band_users_total(cat: Catalog, as_of: str, status: int = PAID) -> DataFrame:
    """Per detail band: distinct users over the whole snapshot."""
    o = paid_orders(cat, as_of, status).select("machine_id", "user_id").distinct()
    return distinct_count(o.join(_banded_racks(cat, as_of), "machine_id"), ["total_people"], "user_id", "user_qyt")


def band_monthly_sales(cat: Catalog, as_of: str, racks_as_of: str, month_fmt: str = MONTH_FMT,
                       status: int = PAID) -> DataFrame:
    """Per month x fine company band: selling days, rack-days with sales, orders, GMV and GMV per
    rack-day. Racks come from snapshot ``racks_as_of``; racks of companies without a band count under
    a null band (left join)."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt)
    m = racks_at(cat, racks_as_of).select("machine_id", "customer_id")
    t = company_band(cat, as_of).select("customer_id", "total_people")
    mt = m.join(t, "customer_id", "left")
    per = (o.groupBy("month", "payday", "machine_id").agg(F.count("order_id").alias("order_qyt"),
                                                          F.sum("origin_amount").alias("ori"))
           .join(mt, "machine_id"))
    g = per.groupBy("month", "total_people").agg(
        F.countDistinct("payday").alias("days"), F.count("machine_id").alias("machine_days"),
        F.sum("order_qyt").alias("order_qyt"), F.sum("ori").alias("ori"))
    return g.select("month", "total_people", "days", "machine_days", "order_qyt", money("ori").alias("ori"),
                    ratio("ori", "machine_days").alias("ori_per_machine"))
