"""Buyers: new vs returning, cumulative distinct buyers, first touches, weekly cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.functions.agg import distinct_count
from rackpulse.functions.bitset import bit, has_bit
from rackpulse.functions.dates import MONTH_FMT, month_key, month_of_day_key
from rackpulse.functions.ratio import ratio
from rackpulse.operators.calendar import WEEK_SUFFIX, YEAR_SUFFIX
from rackpulse.operators.common import paid_items, paid_orders, with_keys
from rackpulse.sources.catalog import PAID, Catalog, snapshot

ROUND = 6
_NO_WEEK = 63  # bit of a trade without a week


def new_users_in_month(cat: Catalog, as_of: str, month: int = 12, status: int = PAID) -> DataFrame:
    """Users whose first paid order falls in month-of-year ``month`` (any year)."""
    first = paid_orders(cat, as_of, status).groupBy("user_id").agg(
        F.min("pay_complete_time").alias("first_time"))
    return first.where(F.month("first_time") == month).agg(F.count("user_id").alias("user_qyt"))


def _user_month(cat: Catalog, as_of: str, month_fmt: str, status: int) -> DataFrame:
    """Per (month, user): orders, GMV and how many orders have one, net sales."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt)
    return (o.groupBy("month", "user_id")
            .agg(F.count("order_id").alias("order_qyt"), F.sum("origin_amount").alias("ori"),
                 F.count("origin_amount").alias("ori_qyt"), F.sum("actual_amount").alias("act")))


def _first_month(cat: Catalog, as_of: str, month_fmt: str) -> DataFrame:
    """First purchase month per user, from the user dimension's first-order day key."""
    u = snapshot(cat.table("user_info"), as_of)
    return u.select("user_id", month_of_day_key("rack_first_order", month_fmt).alias("first_month"))


def month_users_and_new(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT,
                        status: int = PAID) -> DataFrame:
    """Per month: buying users, next to new users (by the user dimension's first order)."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt)
    users = distinct_count(o, ["month"], "user_id", "user_qyt")
    new = distinct_count(_first_month(cat, as_of, month_fmt).withColumnRenamed("first_month", "month"),
                         ["month"], "user_id", "new_user")
    return users.join(new, "month").select("month", "user_qyt", "new_user")


def _running_first_seen(firsts: DataFrame, periods: DataFrame | None, period: str, id_col: str, out: str,
                        keep_empty: bool = True) -> DataFrame:
    """Cumulative distinct ids per period: ids counted at their first period, then a running sum
    over the (few) periods. Equal to joining every period with every earlier (period, id) pair and
    counting distinct ids, but linear instead of quadratic; a null id holds its period, never a count.
    The window has no partition key; it runs over the aggregated periods only (tens to hundreds of
    rows), never over raw rows.

    ``periods=None`` reports the periods of ``firsts``; otherwise first periods outside ``periods`` are
    carried into the running sum and then dropped."""
    new = firsts.groupBy(period).agg(F.count(id_col).alias("_new"))
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum("_new").over(w).cast("bigint").alias(out)
    if periods is not None:
        zero = periods.select(period, F.lit(0).cast("bigint").alias("_new"), F.lit(True).alias("_asked"))
        both = new.withColumn("_asked", F.lit(False)).unionByName(zero)
        both = both.groupBy(period).agg(F.sum("_new").alias("_new"), F.max("_asked").alias("_asked"))
        return _kept(both.select(period, run, "_asked").where("_asked").drop("_asked"), out, keep_empty)
    return _kept(new.select(period, run), out, keep_empty)


def _kept(run: DataFrame, out: str, keep_empty: bool) -> DataFrame:
    return run if keep_empty else run.where(F.col(out) > 0)


def cumulative_distinct(df: DataFrame, period: str, id_col: str, periods: DataFrame | None = None,
                        out: str = "cumulative", keep_empty: bool = True) -> DataFrame:
    """Distinct ``id_col`` values seen up to and including each period (B15); nulls are not counted.

    ``periods`` lists the periods to report (default: the periods present in ``df``, also those with null
    ids only); periods before an id's first one do not count it. One scan, linear: distinct (id,
    period) rows give both an id's first period and the periods there are; then a count per period
    and a running sum.
    """
    pairs = df.select(F.col(id_col).alias("_id"), period).distinct()
    if periods is not None:
        firsts = pairs.where("_id is not null").groupBy("_id").agg(F.min(period).alias(period))
        return _running_first_seen(firsts, periods.select(period).distinct(), period, "_id", out, keep_empty)
    # an id's first row counts it, its other rows only hold their periods
    first = F.min(period).over(Window.partitionBy("_id", "_part"))
    # null ids are spread over their periods, so that the window has no group larger than an id's periods
    marked = pairs.withColumn("_part", F.when(F.col("_id").isNull(), F.col(period))).withColumn("_first", first)
    return _running_first_seen(marked.select(period, F.when(F.col(period) == F.col("_first"), F.col("_id")).alias("_id")),
                               None, period, "_id", out, keep_empty)


def cumulative_buyers(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Per month with sales: distinct buyers up to and including that month."""
    o = with_keys(paid_orders(cat, as_of, status), month_fmt)
    return cumulative_distinct(o, "month", "user_id", out="user_qyt")


def cumulative_buyers_from(cat: Catalog, as_of: str, firsts: DataFrame, month_fmt: str = MONTH_FMT,
                           status: int = PAID) -> DataFrame:
    """``cumulative_buyers`` from a kept first-order table (``sources.firsts``): one row per buyer gives the counts; of the
    orders only the months are read."""
    months = with_keys(paid_orders(cat, as_of, status), month_fmt).select("month").distinct()
    seen = firsts.select(month_key("pay_complete_time", month_fmt).alias("month"), "user_id")
    return _running_first_seen(seen, months, "month", "user_id", "user_qyt")


def cumulative_buyers_range(cat: Catalog, as_of: str, year: int | None = None,
                            status: int = PAID) -> DataFrame:
    """Per calendar month (of ``year``, or all): distinct buyers of order lines up to that month,
    months without sales included."""
    items = paid_items(cat, as_of, status).select(month_key("pay_complete_time", "yyyyMM").alias("month_id"),
                                                  "user_id")
    cal = cat.table("calendar")
    if year is not None:
        cal = cal.where(F.col("year_id") == year)
    # an inner range join: a month before the first sale has no partner row and no output row
    return cumulative_distinct(items, "month_id", "user_id", cal.select("month_id"), "user_qty", keep_empty=False)


def buyer_count(cat: Catalog, as_of: str, status: int = PAID) -> DataFrame:
    """Distinct buyers in snapshot ``as_of``."""
    return distinct_count(paid_orders(cat, as_of, status), [], "user_id", "user_qyt")


def _new_old(cat: Catalog, as_of: str, month_fmt: str, status: int, new: bool) -> DataFrame:
    um = _user_month(cat, as_of, month_fmt, status)
    j = um.join(_first_month(cat, as_of, month_fmt), "user_id")
    return j.where(F.col("first_month") == F.col("month")) if new else \
        j.where(F.col("first_month") < F.col("month"))


def new_user_frequency(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Average orders per new user in their first month."""
    j = _new_old(cat, as_of, month_fmt, status, new=True)
    return j.groupBy("first_month").agg(F.avg("order_qyt").alias("avg_order"))


def old_user_frequency(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Average orders per returning user, per month."""
    j = _new_old(cat, as_of, month_fmt, status, new=False)
    return j.groupBy("month").agg(F.avg("order_qyt").alias("avg_order"))


def new_user_spend(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Average GMV per new user in their first month."""
    j = _new_old(cat, as_of, month_fmt, status, new=True)
    return j.groupBy("month").agg(ratio(F.sum("ori"), F.count("ori")).alias("avg_order"))


def new_user_orders(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Orders of new users in their first month."""
    j = _new_old(cat, as_of, month_fmt, status, new=True)
    return j.groupBy("month").agg(F.sum("order_qyt").alias("order_qyt"))


def old_user_ticket(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """Average over returning users of their average order value in the month (orders without an amount
    have no part in it)."""
    j = _new_old(cat, as_of, month_fmt, status, new=False)
    per_user = j.withColumn("avg_ori", ratio("ori", "ori_qyt"))
    return per_user.groupBy("month").agg(F.round(F.avg("avg_ori"), ROUND).alias("avg_ori"))


def new_user_ticket(cat: Catalog, as_of: str, month_fmt: str = MONTH_FMT, status: int = PAID) -> DataFrame:
    """GMV / orders of new users in their first month."""
    j = _new_old(cat, as_of, month_fmt, status, new=True)
    return j.groupBy("month").agg(ratio(F.sum("ori"), F.sum("order_qyt")).alias("ticket"))


# ---- fixed values: the page view counted as a first touch ----
APP_NAME, PAGE_NAME, LOG_TYPE = "app-openrack-h5", "commodity_list", "pv"
# ---- end of fixed values ----


def event_first_touch(cat: Catalog, app_name: str = APP_NAME, page_name: str = PAGE_NAME,
                      log_type: str = LOG_TYPE) -> DataFrame:
    """First matching page view per account user (B45): events filtered on app, page and log type,
    bridged to account users by token. ``min(create_time)`` per user combines map-side."""
    ev = cat.table("user_event").where((F.col("app_name") == app_name) & (F.col("page_name") == page_name)
                                       & (F.col("log_type") == log_type))
    tok = cat.table("account_token").select("token", F.col("user_id").alias("account_user"))
    views = ev.select("token", "create_time").join(tok, "token")
    return views.groupBy("account_user").agg(F.min("create_time").alias("first_view"))


def cumulative_viewers(cat: Catalog, period_fmt: str = "yyyy-MM", app_name: str = APP_NAME,
                       page_name: str = PAGE_NAME, log_type: str = LOG_TYPE) -> DataFrame:
    """Cumulative first-time page viewers per period: page views bridged to account users by
    token, each account user counted in the period of its first view."""
    first = event_first_touch(cat, app_name, page_name, log_type)
    firsts = first.select(F.date_format("first_view", period_fmt).alias("mon"), "account_user")
    return _running_first_seen(firsts, None, "mon", "account_user", "sum_user")


def _week_label(year: str, week: str):
    return F.concat(F.col(year).cast("string"), F.lit(YEAR_SUFFIX), F.col(week).cast("string"), F.lit(WEEK_SUFFIX))


def _week_monday(year: str, week: str):
    """Monday of ISO week ``week`` of ISO year ``year``: that of week 1 holds January 4th."""
    first = F.to_date(F.date_trunc("week", F.make_date(F.col(year).cast("int"), F.lit(1), F.lit(4))))
    return F.date_add(first, ((F.col(week) - 1) * 7).cast("int"))


def weekly_cohort(cat: Catalog, second_year: int | None = None) -> DataFrame:
    """Distinct users per (purchase week, first-purchase week, weeks since the first week).

    The two tables need year, week of year and user only. A user's weeks of a year are one word of bits (bit = week of
    the year, 63 for none), so a row per trade becomes a row per user and year in one aggregate; that meets the user's
    first week, and the set bits are read off. The week gap is the number of weeks between the two
    ISO-week Mondays, which stays right across New Year; with ``second_year`` it is the source's
    own index instead: the week number, plus 52 in that year."""
    def index():
        return F.col("week_of_year") + F.when(F.col("year") == second_year, 52).otherwise(0)

    f = cat.table("user_first_day").select(
        F.col("user_id").alias("_user"), _week_label("year", "week_of_year").alias("week_first"), index().alias("_week_first"),
        _week_monday("year", "week_of_year").alias("_mon_first")).distinct()
    active = cat.table("trade_detail").groupBy("user_id", "year").agg(
        F.bit_or(bit(F.coalesce("week_of_year", F.lit(_NO_WEEK)))).alias("_weeks"))
    j = active.join(f, F.col("user_id") == F.col("_user"), "left")
    j = j.withColumn("_bit", F.explode(F.filter(F.array(*[F.lit(w) for w in range(64)]), lambda w: has_bit(F.col("_weeks"), w))))
    j = j.withColumn("week_of_year", F.when(F.col("_bit") != _NO_WEEK, F.col("_bit")))
    gap = (index() - F.col("_week_first")) if second_year is not None else (
        F.datediff(_week_monday("year", "week_of_year"), "_mon_first") / 7)
    # a user is in a (week, first week) once, so rows are users
    return j.groupBy(_week_label("year", "week_of_year").alias("week"), "week_first", gap.cast("int").alias("cut")).agg(
        F.count("user_id").alias("user_num"))


def repeat_rate(cohort: DataFrame) -> DataFrame:
    """Share of each weekly cohort buying again ``cut`` weeks later. The cohort size is taken with a
    window over ``week_first`` instead of a self join (one scan of the cohort table)."""
    w = Window.partitionBy("week_first")
    sized = cohort.withColumn(
        "new_user", F.max(F.when(F.col("week") == F.col("week_first"), F.col("user_num"))).over(w))
    return (sized.where((F.col("cut") > 0) & F.col("new_user").isNotNull())
            .select("week_first", "new_user", "cut", "user_num",
                    ratio("user_num", "new_user").alias("buy_rate")))
