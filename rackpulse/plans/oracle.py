"""DuckDB oracle SQL, one statement per registered report.

Each statement is written from the report's definition as plain DuckDB SQL over the fixture CTEs
(``oracle_tables``): one CTE per step, ``GROUP BY ALL``, ``FILTER`` for conditional aggregates,
``QUALIFY`` for first / top-N rows, range joins for cumulative counts. The shapes deliberately differ
from the Spark operators (which pre-aggregate, use first-seen running sums, min-struct first rows, ...),
so the two check each other. Fixture parameters are inlined (see ``registry``); money leaves as DOUBLE,
integer sums as BIGINT, like the Spark side.
"""

from rackpulse.operators.derived import DERIVED
from rackpulse.plans.oracle_tables import with_tables
from rackpulse.plans.registry import KEPT

AS_OF = "'20011231'"
WORKDAY = "'工作日'"


# ---- fixed values: size bands and imputation as SQL (text that is not a number compares as NULL) ----
SQL_COARSE = """CASE WHEN {x} IS NULL OR {x} = '' THEN 'empty'
    WHEN TRY_CAST({x} AS DOUBLE) < 30 THEN '30-' WHEN TRY_CAST({x} AS DOUBLE) < 50 THEN '30-50'
    WHEN TRY_CAST({x} AS DOUBLE) < 100 THEN '50-100' WHEN TRY_CAST({x} AS DOUBLE) < 300 THEN '100-300'
    WHEN TRY_CAST({x} AS DOUBLE) >= 300 THEN '300+' ELSE 'other' END"""
SQL_FINE = """CASE WHEN TRY_CAST({x} AS DOUBLE) < 25 THEN '1~24' WHEN TRY_CAST({x} AS DOUBLE) < 50 THEN '25~49'
    WHEN TRY_CAST({x} AS DOUBLE) < 100 THEN '50~99' WHEN TRY_CAST({x} AS DOUBLE) < 300 THEN '100~299'
    WHEN TRY_CAST({x} AS DOUBLE) < 500 THEN '300~499' WHEN TRY_CAST({x} AS DOUBLE) >= 500 THEN '500+' ELSE {x} END"""
SQL_DETAIL = """CASE WHEN TRY_CAST({x} AS DOUBLE) < 30 THEN '30-' WHEN TRY_CAST({x} AS DOUBLE) < 50 THEN '30~49'
    WHEN TRY_CAST({x} AS DOUBLE) < 100 THEN '50~99' WHEN TRY_CAST({x} AS DOUBLE) < 300 THEN '100~299'
    WHEN TRY_CAST({x} AS DOUBLE) >= 300 THEN '300+' ELSE {x} END"""
IMPUTED_COARSE = """CASE WHEN tp IS NULL THEN '30~50' WHEN tp = '' AND machine_qyt < 4 THEN '30~50'
    WHEN tp = '' AND machine_qyt BETWEEN 4 AND 10 THEN '100~300' WHEN tp = '' AND machine_qyt > 10 THEN '300+' ELSE tp END"""
IMPUTED_FINE = """CASE WHEN tp IS NULL THEN '30' WHEN tp = '' AND machine_qyt <= 2 THEN '30'
    WHEN tp = '' AND machine_qyt = 3 THEN '50' WHEN tp = '' AND machine_qyt BETWEEN 4 AND 10 THEN '100'
    WHEN tp = '' AND machine_qyt BETWEEN 11 AND 16 THEN '300' WHEN tp = '' AND machine_qyt > 16 THEN '500' ELSE tp END"""
# ---- end of fixed values ----


def sql_band(x: str, band: str) -> str:
    return band.replace("{x}", x)


# helper CTEs shared by the statements (DuckDB drops the unused ones)
BASE = f"""
po AS (
  SELECT *, strftime(pay_complete_time, '%Y%m%d') AS d_key, strftime(pay_complete_time, '%Y%m') AS m_key
  FROM rack_order WHERE pt = {AS_OF} AND pay_status = 64
),
pi AS (
  SELECT *, strftime(pay_complete_time, '%Y%m%d') AS d_key, strftime(pay_complete_time, '%Y%m') AS m_key
  FROM order_item WHERE pt = {AS_OF} AND pay_status = 64
),
rk AS (SELECT * FROM rack WHERE pt = {AS_OF}),
co AS (SELECT * FROM company WHERE pt = {AS_OF}),
workdays AS (SELECT day_id FROM calendar WHERE day_type = {WORKDAY}),
hc_text AS (
  SELECT customer_id, total_people AS raw_text, kept,
         CASE WHEN kept > 0 THEN regexp_extract(substr(total_people, 1, CAST(kept AS INTEGER)), '([0-9]+)', 1)
              ELSE '' END AS parsed
  FROM (SELECT *, CAST(length(replace(total_people, '+', '')) AS BIGINT) AS kept FROM company_raw)
),
city_racks AS (
  SELECT customer_id, count(DISTINCT machine_id) AS machine_qyt FROM rk WHERE city_name IS NOT NULL GROUP BY ALL
),
size_own AS (
  SELECT customer_id, co.corp_name, coalesce(co.total_people, h.parsed) AS tp, cr.machine_qyt
  FROM co JOIN hc_text h USING (customer_id) JOIN city_racks cr USING (customer_id)
),
size_parsed AS (
  SELECT customer_id, coalesce(h.parsed, co.total_people) AS tp, cr.machine_qyt
  FROM co JOIN hc_text h USING (customer_id) JOIN city_racks cr USING (customer_id)
),
company_size AS (
  SELECT customer_id, corp_name, {IMPUTED_COARSE} AS total_people, machine_qyt
  FROM size_own
),
headcount_detail AS (
  SELECT customer_id, {IMPUTED_FINE} AS total_people, machine_qyt FROM size_parsed
),
company_band AS (
  SELECT customer_id, {sql_band('total_people', SQL_FINE)} AS total_people, machine_qyt FROM headcount_detail
),
detail_band AS (SELECT customer_id, {sql_band('total_people', SQL_DETAIL)} AS total_people FROM headcount_detail),
active AS (SELECT machine_id, customer_id FROM rk WHERE release_status IN (2, 3)),
small_companies AS (
  SELECT customer_id, co.corp_name, h.parsed AS total_people, count(*) AS machine_qyt
  FROM active JOIN co USING (customer_id) JOIN hc_text h USING (customer_id)
  WHERE h.kept > 0 AND TRY_CAST(h.parsed AS DOUBLE) < 50
  GROUP BY ALL
  UNION ALL
  SELECT customer_id, co.corp_name, h.raw_text AS total_people, count(*) AS machine_qyt
  FROM active JOIN co USING (customer_id) JOIN hc_text h USING (customer_id)
  WHERE h.raw_text IS NULL OR h.raw_text = ' '
  GROUP BY ALL
),
weekly_rack AS (
  SELECT city_name, machine_id, CAST(isoyear(pay_complete_time) * 100 + week(pay_complete_time) AS INTEGER) AS weekno,
         count(DISTINCT order_id) AS order_qyt
  FROM po GROUP BY ALL
),
rack_band AS (SELECT machine_id, customer_id, b.total_people FROM rk JOIN detail_band b USING (customer_id)),
user_first AS (SELECT user_id, left(rack_first_order, 6) AS first_month FROM user_info WHERE pt = {AS_OF}),
user_month AS (
  SELECT m_key AS month, user_id, count(DISTINCT order_id) AS n, sum(origin_amount) AS g,
         count(origin_amount) AS n_amounts FROM po GROUP BY ALL
),
cohort AS (
  SELECT CAST(t.year AS VARCHAR) || '年' || CAST(t.week_of_year AS VARCHAR) || '周' AS week,
         CAST(f.year AS VARCHAR) || '年' || CAST(f.week_of_year AS VARCHAR) || '周' AS week_first,
         CAST(datediff('day', f.monday, t.monday) // 7 AS INTEGER) AS cut,
         count(DISTINCT t.user_id) AS user_num
  FROM (SELECT *, CAST(date_trunc('week', make_date(year, 1, 4)) AS DATE) + 7 * (week_of_year - 1) AS monday
        FROM trade_detail) t
  LEFT JOIN (SELECT *, CAST(date_trunc('week', make_date(year, 1, 4)) AS DATE) + 7 * (week_of_year - 1) AS monday
             FROM user_first_day) f USING (user_id)
  GROUP BY ALL
),
day_rack_user AS (
  SELECT d_key, machine_id, user_id, count(DISTINCT order_id) AS n, sum(origin_amount) AS g,
         sum(actual_amount) AS a
  FROM po GROUP BY ALL
),
rack_pivot AS (
  SELECT d.machine_id,
{{PIVOT}}
  FROM day_rack_user d JOIN calendar c ON c.day_id = d.d_key
  GROUP BY d.machine_id
),
since_1995 AS (
  SELECT m_key AS month, d_key, machine_id, count(DISTINCT order_id) AS n, sum(origin_amount) AS g
  FROM po WHERE pay_complete_time >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY ALL
),
units AS (
  SELECT machine_id, d_key, sum(quantity) AS q FROM pi
  WHERE pay_complete_time > TIMESTAMP '1994-12-31 00:00:00' GROUP BY ALL
),
capacity AS (SELECT machine_id, sum(max_inventory) AS cap FROM stock WHERE is_valid = 1 GROUP BY ALL)
"""

PIVOT_MONTHS = range(6, 13)
BASE = BASE.replace("{PIVOT}", ",\n".join(
    f"    CAST(coalesce(sum(d.n) FILTER (WHERE c.month_short_id = {m}), 0) AS BIGINT) AS order_qyt{m},\n"
    f"    count(DISTINCT d.user_id) FILTER (WHERE c.month_short_id = {m}) AS user_qyt{m},\n"
    f"    CAST(coalesce(sum(d.g) FILTER (WHERE c.month_short_id = {m}), 0) AS DOUBLE) AS ori{m},\n"
    f"    CAST(coalesce(sum(d.a) FILTER (WHERE c.month_short_id = {m}), 0) AS DOUBLE) AS act{m}"
    for m in PIVOT_MONTHS))

RACK_LIST = """machine_id, machine_name, customer_id, machine_type_name, machine_sub_type_name, address,
  strftime(online_time, '%Y%m%d') AS online_date,
  CASE WHEN release_status = -1 AND online_time IS NOT NULL THEN strftime(update_time, '%Y%m%d') ELSE '无' END
    AS offline_date,
  city_name"""

NAMES = ", ".join(f"'Supplier#{i:09d}'" for i in range(1, 13))

ORACLE: dict[str, str] = {
    # ---------------- headcount chain ----------------
    "headcount_length": "SELECT customer_id, kept AS leng FROM hc_text",
    "headcount_parsed": "SELECT customer_id, parsed AS total_people FROM hc_text",
    "size_distribution": f"""
WITH new_racks AS (
  SELECT machine_id, customer_id FROM rk
  WHERE online_time >= TIMESTAMP '1995-01-01 00:00:00' AND online_time < TIMESTAMP '2002-01-01 00:00:00'
), per_company AS (
  SELECT customer_id, co.corp_name, {sql_band('h.parsed', SQL_COARSE)} AS total_people, count(*) AS racks
  FROM new_racks JOIN co USING (customer_id) JOIN hc_text h USING (customer_id)
  WHERE h.kept > 0
  GROUP BY ALL
)
SELECT total_people, CAST(sum(racks) AS BIGINT) AS machine_qyt, count(DISTINCT customer_id) AS customer_qyt
FROM per_company GROUP BY ALL""",
    "small_companies": "SELECT customer_id, corp_name, total_people, machine_qyt FROM small_companies",
    "company_weekly_sales": """
SELECT w.city_name, s.customer_id, s.corp_name, s.total_people, r.machine_name, r.machine_type_name,
       r.machine_sub_type_name, w.weekno, w.order_qyt
FROM small_companies s JOIN co ON co.customer_id = s.customer_id
JOIN rk r ON r.customer_id = s.customer_id
JOIN weekly_rack w ON w.machine_id = r.machine_id""",
    "rack_grade_detail": f"""
WITH avg_week AS (SELECT city_name, machine_id, avg(order_qyt) AS order_qyt FROM weekly_rack GROUP BY ALL)
SELECT w.city_name, {sql_band('h.parsed', SQL_COARSE)} AS total_people, r.machine_id, g.machine_grading,
       r.machine_sub_type_name, w.order_qyt
FROM hc_text h JOIN co ON co.customer_id = h.customer_id
JOIN rk r ON r.customer_id = h.customer_id
JOIN rack_grade g ON g.machine_id = r.machine_id AND g.pt = {AS_OF}
JOIN avg_week w ON w.machine_id = r.machine_id""",
    "company_size": "SELECT customer_id, total_people, machine_qyt FROM company_size",
    "company_band": "SELECT customer_id, total_people, machine_qyt FROM company_band",
    "racks_by_band": """
SELECT b.total_people, count(DISTINCT a.machine_id) AS machine_qyt
FROM active a JOIN company_band b USING (customer_id) GROUP BY ALL""",
    "active_racks_by_band": """
SELECT b.total_people, count(DISTINCT a.machine_id) AS machine_qyt
FROM active a JOIN detail_band b USING (customer_id) GROUP BY ALL""",
    "racks_by_band_two_snapshots": """
WITH earlier AS (SELECT DISTINCT machine_id FROM rack WHERE pt = '19970731' AND release_status IN (2, 3)),
     placed AS (SELECT machine_id, rk.customer_id FROM earlier JOIN rk USING (machine_id))
SELECT b.total_people, count(DISTINCT p.machine_id) AS machine_qyt
FROM placed p JOIN detail_band b USING (customer_id) GROUP BY ALL""",
    "band_monthly_sales": """
WITH day_rack AS (
  SELECT m_key AS month, d_key, machine_id, count(DISTINCT order_id) AS n, sum(origin_amount) AS g
  FROM po GROUP BY ALL
), banded AS (
  SELECT d.*, b.total_people FROM day_rack d JOIN rk ON rk.machine_id = d.machine_id
  LEFT JOIN company_band b ON b.customer_id = rk.customer_id
)
SELECT month, total_people, count(DISTINCT d_key) AS days, count(*) AS machine_days,
       CAST(sum(n) AS BIGINT) AS order_qyt, CAST(sum(g) AS DOUBLE) AS ori,
       CAST(sum(g) AS DOUBLE) / count(*) AS ori_per_machine
FROM banded GROUP BY ALL""",
    "band_monthly_sales_two_snapshots": """
WITH day_rack AS (
  SELECT m_key AS month, d_key, machine_id, count(DISTINCT order_id) AS n, sum(origin_amount) AS g
  FROM po GROUP BY ALL
), banded AS (
  SELECT d.*, b.total_people FROM day_rack d
  JOIN (SELECT * FROM rack WHERE pt = '19970731') r ON r.machine_id = d.machine_id
  LEFT JOIN company_band b ON b.customer_id = r.customer_id
)
SELECT month, total_people, count(DISTINCT d_key) AS days, count(*) AS machine_days,
       CAST(sum(n) AS BIGINT) AS order_qyt, CAST(sum(g) AS DOUBLE) AS ori,
       CAST(sum(g) AS DOUBLE) / count(*) AS ori_per_machine
FROM banded GROUP BY ALL""",
    "band_orders_gmv": """
WITH per_rack AS (
  SELECT po.m_key AS month, po.machine_id, b.total_people, count(DISTINCT po.order_id) AS n,
         sum(po.origin_amount) AS g
  FROM po JOIN rack_band b ON b.machine_id = po.machine_id GROUP BY ALL
)
SELECT month, total_people, CAST(sum(n) AS BIGINT) AS order_qyt, CAST(sum(g) AS DOUBLE) AS GMV
FROM per_rack GROUP BY ALL""",
    "band_users": """
WITH per_company AS (
  SELECT po.m_key AS month, b.customer_id, b.total_people, count(DISTINCT po.user_id) AS u
  FROM po JOIN rack_band b ON b.machine_id = po.machine_id GROUP BY ALL
)
SELECT month, total_people, CAST(sum(u) AS BIGINT) AS user_qyt FROM per_company GROUP BY ALL""",
    "band_users_total": """
SELECT b.total_people, count(DISTINCT po.user_id) AS user_qyt
FROM po JOIN rack_band b ON b.machine_id = po.machine_id GROUP BY ALL""",
    # ---------------- racks ----------------
    "city_count": "SELECT count(DISTINCT city_name) AS city_qyt FROM active JOIN rk USING (machine_id)",
    "rack_list": f"SELECT {RACK_LIST} FROM rk WHERE release_status IN (2, 3, -1) AND city_name IS NOT NULL",
    "daily_online_vs_active": """
WITH sold AS (
  SELECT d_key, count(DISTINCT order_id) AS order_qyt, CAST(sum(origin_amount) AS DOUBLE) AS ori,
         count(DISTINCT machine_id) AS deal_cnt
  FROM po GROUP BY ALL
), online AS (
  SELECT pt, count(DISTINCT machine_id) AS online_cnt FROM rack
  WHERE release_status IN (2, 3) AND machine_type IN (10, 20) GROUP BY ALL
)
SELECT online.pt AS daykey, order_qyt, ori, deal_cnt, online_cnt FROM sold JOIN online ON online.pt = sold.d_key""",
    "grade_counts": """
SELECT pt, machine_grading, count(DISTINCT machine_id) AS machine_qyt
FROM rack_grade WHERE pt IN ('19971130', '19971228') GROUP BY ALL""",
    # ---------------- sales ----------------
    "daily_kpis": """
SELECT po.d_key AS payday, count(DISTINCT po.order_id) AS order_qyt, CAST(sum(po.origin_amount) AS DOUBLE) AS ori,
       count(DISTINCT po.machine_id) AS machine_qyt, count(DISTINCT rk.customer_id) AS customer_qyt
FROM po JOIN rk ON rk.machine_id = po.machine_id
WHERE po.pay_complete_time > TIMESTAMP '1994-12-31 00:00:00'
GROUP BY ALL""",
    "rack_type_orders": """
SELECT po.d_key AS payday, count(DISTINCT po.order_id) AS order_qyt
FROM po JOIN rk ON rk.machine_id = po.machine_id
WHERE rk.machine_sub_type = 90 AND po.d_key IN ('19971129', '19971130')
GROUP BY ALL""",
    "rack_type_orders_days": """
SELECT po.d_key AS payday, count(DISTINCT po.order_id) AS order_qyt
FROM po JOIN rk ON rk.machine_id = po.machine_id
WHERE rk.machine_sub_type = 10 AND po.d_key IN ('19970601', '19970602', '19970603', '19970604', '19970605')
GROUP BY ALL""",
    "period_total_earlier": """
SELECT CAST(sum(origin_amount) AS DOUBLE) AS ori, count(DISTINCT order_id) AS order_qyt
FROM rack_order WHERE pt = '19991231' AND pay_status = 64 AND pay_complete_time >= TIMESTAMP '1995-01-01 00:00:00'""",
    "weekly_kpis": """
WITH per_day AS (SELECT d_key, count(DISTINCT order_id) AS n, sum(origin_amount) AS g FROM po GROUP BY ALL)
SELECT strftime(c.monday_date, '%Y%m%d') AS monday_date,
       c.year_name_cn || CAST(c.week_of_year AS VARCHAR) || '周' AS week,
       CAST(sum(n) AS BIGINT) AS order_qyt, CAST(sum(g) AS DOUBLE) AS ori,
       CAST(sum(g) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS aov
FROM per_day JOIN calendar c ON c.day_id = per_day.d_key
GROUP BY ALL""",
    "workday_orders": """
WITH per_day AS (
  SELECT d_key, count(DISTINCT order_id) AS n FROM po
  WHERE pay_complete_time > TIMESTAMP '1994-12-31 00:00:00' GROUP BY ALL
)
SELECT CAST(sum(n) AS BIGINT) AS order_qyt FROM per_day WHERE d_key IN (SELECT day_id FROM workdays)""",
    "workday_orders_per_rack": """
WITH per_day AS (
  SELECT d_key, count(DISTINCT order_id) AS n, count(DISTINCT machine_id) AS m FROM po
  WHERE pay_complete_time > TIMESTAMP '1994-12-31 00:00:00' GROUP BY ALL
)
SELECT round(avg(n / nullif(m, 0)), 6) AS order_mac FROM per_day WHERE d_key IN (SELECT day_id FROM workdays)""",
    "workday_month": """
SELECT m_key AS month, count(DISTINCT user_id) AS user_qyt, count(DISTINCT order_id) AS order_qyt,
       CAST(sum(origin_amount) AS DOUBLE) AS ori, CAST(sum(actual_amount) AS DOUBLE) AS act
FROM po WHERE d_key IN (SELECT day_id FROM workdays) GROUP BY ALL""",
    "workday_active_racks": """
WITH per_day AS (
  SELECT m_key AS month, d_key, count(DISTINCT machine_id) AS racks FROM po
  WHERE d_key IN (SELECT day_id FROM workdays) GROUP BY ALL
)
SELECT month, avg(racks) AS machine_qyt FROM per_day GROUP BY ALL""",
    "period_total": """
SELECT CAST(sum(origin_amount) AS DOUBLE) AS ori, count(DISTINCT order_id) AS order_qyt
FROM po WHERE pay_complete_time >= TIMESTAMP '2000-01-01 00:00:00'""",
    # ---------------- users ----------------
    "new_users_in_month": """
SELECT count(user_id) AS user_qyt
FROM (SELECT user_id FROM po GROUP BY user_id HAVING month(min(pay_complete_time)) = 12)""",
    "month_users_and_new": """
WITH buyers AS (SELECT m_key AS month, count(DISTINCT user_id) AS user_qyt FROM po GROUP BY ALL),
     fresh AS (SELECT first_month AS month, count(DISTINCT user_id) AS new_user FROM user_first GROUP BY ALL)
SELECT month, user_qyt, new_user FROM buyers JOIN fresh USING (month)""",
    "cumulative_buyers": """
WITH seen AS (SELECT DISTINCT m_key AS month, user_id FROM po),
     months AS (SELECT DISTINCT month FROM seen)
SELECT m.month, count(DISTINCT s.user_id) AS user_qyt
FROM months m JOIN seen s ON s.month <= m.month GROUP BY ALL""",
    "buyer_count": "SELECT count(DISTINCT user_id) AS user_qyt FROM po",
    "new_user_frequency": """
SELECT f.first_month, avg(u.n) AS avg_order
FROM user_month u JOIN user_first f ON f.user_id = u.user_id AND f.first_month = u.month GROUP BY ALL""",
    "old_user_frequency": """
SELECT u.month, avg(u.n) AS avg_order
FROM user_month u JOIN user_first f ON f.user_id = u.user_id AND f.first_month < u.month GROUP BY ALL""",
    "cumulative_buyers_range": """
WITH months AS (SELECT DISTINCT month_id FROM calendar),
     seen AS (SELECT DISTINCT m_key AS month_id, user_id FROM pi)
SELECT m.month_id, count(DISTINCT s.user_id) AS user_qty
FROM months m JOIN seen s ON s.month_id <= m.month_id GROUP BY ALL""",
    "cumulative_buyers_year": """
WITH months AS (SELECT DISTINCT month_id FROM calendar WHERE year_id = 1997),
     seen AS (SELECT DISTINCT m_key AS month_id, user_id FROM pi)
SELECT m.month_id, count(DISTINCT s.user_id) AS user_qty
FROM months m JOIN seen s ON s.month_id <= m.month_id GROUP BY ALL""",
    "weekly_cohort_index": """
SELECT CAST(t.year AS VARCHAR) || '年' || CAST(t.week_of_year AS VARCHAR) || '周' AS week,
       CAST(f.year AS VARCHAR) || '年' || CAST(f.week_of_year AS VARCHAR) || '周' AS week_first,
       CAST(t.week_of_year + CASE WHEN t.year = 1996 THEN 52 ELSE 0 END
            - f.week_of_year - CASE WHEN f.year = 1996 THEN 52 ELSE 0 END AS INTEGER) AS cut,
       count(DISTINCT t.user_id) AS user_num
FROM trade_detail t LEFT JOIN user_first_day f USING (user_id) GROUP BY ALL""",
    "new_user_spend": """
SELECT u.month, CAST(sum(u.g) AS DOUBLE) / count(*) AS avg_order
FROM user_month u JOIN user_first f ON f.user_id = u.user_id AND f.first_month = u.month GROUP BY ALL""",
    "new_user_orders": """
SELECT u.month, CAST(sum(u.n) AS BIGINT) AS order_qyt
FROM user_month u JOIN user_first f ON f.user_id = u.user_id AND f.first_month = u.month GROUP BY ALL""",
    "old_user_ticket": """
SELECT u.month, round(avg(CAST(u.g AS DOUBLE) / u.n_amounts), 6) AS avg_ori
FROM user_month u JOIN user_first f ON f.user_id = u.user_id AND f.first_month < u.month GROUP BY ALL""",
    "new_user_ticket": """
SELECT u.month, CAST(sum(u.g) AS DOUBLE) / CAST(sum(u.n) AS DOUBLE) AS ticket
FROM user_month u JOIN user_first f ON f.user_id = u.user_id AND f.first_month = u.month GROUP BY ALL""",
    "cumulative_viewers": """
WITH views AS (
  SELECT e.create_time, t.user_id
  FROM user_event e JOIN account_token t ON t.token = e.token
  WHERE e.app_name = 'app-openrack-h5' AND e.page_name = 'commodity_list' AND e.log_type = 'pv'
), first_view AS (
  SELECT * FROM views QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY create_time) = 1
), per_day AS (
  SELECT strftime(create_time, '%Y-%m-%d') AS mon, count(DISTINCT user_id) AS n FROM first_view GROUP BY ALL
)
SELECT mon, CAST(sum(n) OVER (ORDER BY mon) AS BIGINT) AS sum_user FROM per_day""",
    "weekly_cohort": "SELECT week, week_first, cut, user_num FROM cohort",
    "repeat_rate": """
SELECT later.week_first, base.user_num AS new_user, later.cut, later.user_num,
       CAST(later.user_num AS DOUBLE) / CAST(base.user_num AS DOUBLE) AS buy_rate
FROM cohort later JOIN cohort base ON base.week_first = later.week_first AND base.week = base.week_first
WHERE later.cut > 0""",
    # ---------------- marketing ----------------
    "coupon_vs_gmv": """
WITH coupons AS (
  SELECT po.m_key AS month,
         coalesce(sum(c.discount_amount) FILTER (WHERE c.coupon_type = 1), 0) AS c1,
         coalesce(sum(c.discount_amount) FILTER (WHERE c.coupon_type = 2), 0) AS c2
  FROM po JOIN coupon c ON c.order_id = po.order_id
  WHERE c.coupon_type IN (1, 2) AND po.city_name IS NOT NULL
  GROUP BY ALL
), totals AS (SELECT m_key AS month, sum(origin_amount) AS g, sum(actual_amount) AS a FROM po GROUP BY ALL)
SELECT month, CAST(c1 AS DOUBLE) AS cut_1, CAST(c2 AS DOUBLE) AS cut_2, CAST(g AS DOUBLE) AS GMV,
       CAST(a AS DOUBLE) AS act
FROM coupons JOIN totals USING (month)""",
    "acquisition_cost": """
WITH first_order AS (
  SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pay_complete_time, order_id) = 1
), discounted AS (
  SELECT m_key AS month, sum(origin_amount - actual_amount) AS d, count(DISTINCT user_id) AS u
  FROM first_order WHERE origin_amount > actual_amount GROUP BY ALL
)
SELECT month, CAST(d AS DOUBLE) AS cut, u AS new_user, CAST(d AS DOUBLE) / u AS CAC FROM discounted""",
    "acquisition_cost_final": """
WITH first_order AS (
  SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pay_complete_time, order_id) = 1
)
SELECT m_key AS month, CAST(sum(origin_amount - actual_amount) AS DOUBLE) / count(DISTINCT user_id) AS CAC
FROM first_order WHERE origin_amount > actual_amount GROUP BY ALL""",
    "discount_roi": """
SELECT m_key AS month, CAST(sum(origin_amount) AS DOUBLE) AS ori, CAST(sum(actual_amount) AS DOUBLE) AS act,
       CAST(sum(origin_amount - actual_amount) AS DOUBLE) AS cut,
       CAST(sum(actual_amount) AS DOUBLE) / CAST(sum(origin_amount - actual_amount) AS DOUBLE) AS ROI
FROM po WHERE origin_amount > actual_amount GROUP BY ALL""",
    # ---------------- sku ----------------
    "sku_share": f"""
WITH per_sku AS (
  SELECT m_key AS month, city_name, sku_id, CAST(sum(quantity) AS BIGINT) AS qyt, sum(commodity_origin_price * quantity) AS ori
  FROM pi GROUP BY ALL
), named AS (
  SELECT s.*, c.commodity_name, c.div_name, c.dept_name, c.class_name, c.subclass_name
  FROM per_sku s JOIN commodity c ON c.sku_id = s.sku_id AND c.pt = {AS_OF}
), totals AS (
  SELECT month, city_name, CAST(sum(qyt) AS BIGINT) AS city_qyt, sum(ori) AS city_ori FROM named GROUP BY ALL
)
SELECT month, city_name, sku_id, commodity_name, div_name, dept_name, class_name, subclass_name, qyt, city_qyt,
       CAST(qyt AS DOUBLE) / CAST(city_qyt AS DOUBLE) AS qyt_percent, CAST(ori AS DOUBLE) AS ori,
       CAST(city_ori AS DOUBLE) AS city_ori, CAST(ori AS DOUBLE) / CAST(city_ori AS DOUBLE) AS ori_percent
FROM named JOIN totals USING (month, city_name)""",
    "sku_monthly": """
SELECT m_key AS month, sku_id, commodity_name, CAST(sum(quantity) AS BIGINT) AS qyt,
       CAST(sum(commodity_origin_price * quantity) AS DOUBLE) AS ori, CAST(sum(commodity_sale_price * quantity) AS DOUBLE) AS act
FROM pi GROUP BY ALL""",
    "sku_monthly_reach": """
SELECT m_key AS month, sku_id, commodity_name, CAST(sum(quantity) AS BIGINT) AS qyt,
       CAST(sum(commodity_origin_price * quantity) AS DOUBLE) AS ori, CAST(sum(commodity_sale_price * quantity) AS DOUBLE) AS act,
       count(DISTINCT machine_id) AS machine_qyt, count(DISTINCT user_id) AS user_qyt,
       count(DISTINCT order_id) AS order_qyt
FROM pi GROUP BY ALL""",
    "category_sales": f"""
WITH per_sku AS (
  SELECT m_key AS month, sku_id, count(DISTINCT order_id) AS n, sum(quantity) AS q
  FROM pi WHERE month(pay_complete_time) IN (11, 12) GROUP BY ALL
)
SELECT s.month, c.div_name, CAST(sum(s.n) AS BIGINT) AS order_qyt, CAST(sum(s.q) AS BIGINT) AS qyt
FROM per_sku s JOIN commodity c ON c.sku_id = s.sku_id AND c.pt = {AS_OF} GROUP BY ALL""",
    # ---------------- inventory ----------------
    "avg_full_stock": "SELECT avg(cap) AS max_inventory FROM capacity",
    "avg_full_stock_hist": """
SELECT avg(cap) AS max_inventory
FROM (SELECT machine_id, sum(max_inventory) AS cap FROM stock_his
      WHERE is_valid = 1 AND day_id = '19971231' GROUP BY ALL)""",
    "avg_daily_units": """
WITH per_rack AS (
  SELECT machine_id, avg(q) AS rate FROM units WHERE d_key IN (SELECT day_id FROM workdays) GROUP BY ALL
)
SELECT round(avg(rate), 6) AS qyt FROM per_rack""",
    "sku_count": """
SELECT count(DISTINCT sku_id) AS sku_qyt FROM stock_his WHERE day_id = '19971231' AND is_valid = 1""",
    "supplier_count": """
SELECT count(DISTINCT supplier_code) AS supplier_qyt FROM supplier_product_his
WHERE day_id = '19971231' AND is_valid = 1""",
    "turnover_days": """
WITH rate AS (SELECT machine_id, avg(q) AS rate FROM units GROUP BY ALL)
SELECT round(avg(CAST(cap AS DOUBLE) / rate), 6) AS zzdays FROM capacity JOIN rate USING (machine_id)""",
    # ---------------- rack reports ----------------
    "rack_month_pivot": "SELECT * FROM rack_pivot",
    "rack_master_report": f"""
WITH listed AS (SELECT {RACK_LIST} FROM rk WHERE release_status IN (2, 3, -1))
SELECT l.*, s.corp_name, s.total_people, s.machine_qyt,
       {", ".join(f"p.order_qyt{m}, p.user_qyt{m}, p.ori{m}, p.act{m}" for m in PIVOT_MONTHS)}
FROM listed l LEFT JOIN company_size s ON s.customer_id = l.customer_id
LEFT JOIN rack_pivot p ON p.machine_id = l.machine_id""",
    "top_racks_sold_days": """
WITH per_month AS (
  SELECT month, machine_id, CAST(sum(n) AS BIGINT) AS n, sum(g) AS g, count(DISTINCT d_key) AS days
  FROM since_1995 GROUP BY ALL
)
SELECT month, machine_id, n AS leiji_order, CAST(g AS DOUBLE) AS leiji_ori, days AS leiji_days,
       n / days AS order_day, CAST(g AS DOUBLE) / days AS ori_day,
       CAST(row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id) AS INTEGER) AS rn
FROM per_month
QUALIFY row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id) <= 1000""",
    "top_racks_sold_days_cut": """
WITH per_month AS (
  SELECT month, machine_id, CAST(sum(n) AS BIGINT) AS n, sum(g) AS g, count(DISTINCT d_key) AS days
  FROM since_1995 GROUP BY ALL
)
SELECT month, machine_id, n AS leiji_order, CAST(g AS DOUBLE) AS leiji_ori, days AS leiji_days,
       n / days AS order_day, CAST(g AS DOUBLE) / days AS ori_day,
       CAST(row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id) AS INTEGER) AS rn
FROM per_month
QUALIFY row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id) <= 5""",
    "top_racks_online_days": """
WITH per_month AS (
  SELECT month, machine_id, CAST(sum(n) AS BIGINT) AS n, sum(g) AS g FROM since_1995 GROUP BY ALL
), online AS (
  SELECT left(pt, 6) AS month, machine_id, machine_name, count(DISTINCT pt) AS online_days
  FROM rack WHERE pt BETWEEN '19950101' AND '20011130' AND release_status IN (2, 3) GROUP BY ALL
)
SELECT month, machine_id, machine_name, n AS order_qyt, CAST(g AS DOUBLE) AS ori, online_days,
       n / online_days AS order_day, CAST(g AS DOUBLE) / online_days AS ori_day,
       CAST(row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id, machine_name) AS INTEGER) AS rn
FROM per_month JOIN online USING (month, machine_id)
QUALIFY row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id, machine_name) <= 1000""",
    "top_racks_online_days_cut": """
WITH per_month AS (
  SELECT month, machine_id, CAST(sum(n) AS BIGINT) AS n, sum(g) AS g FROM since_1995 GROUP BY ALL
), online AS (
  SELECT left(pt, 6) AS month, machine_id, machine_name, count(DISTINCT pt) AS online_days
  FROM rack WHERE pt BETWEEN '19950101' AND '20011130' AND release_status IN (2, 3) GROUP BY ALL
)
SELECT month, machine_id, machine_name, n AS order_qyt, CAST(g AS DOUBLE) AS ori, online_days,
       n / online_days AS order_day, CAST(g AS DOUBLE) / online_days AS ori_day,
       CAST(row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id, machine_name) AS INTEGER) AS rn
FROM per_month JOIN online USING (month, machine_id)
QUALIFY row_number() OVER (PARTITION BY month ORDER BY g DESC, machine_id, machine_name) <= 5""",
    "rack_month_profit": f"""
WITH dmu AS (
  SELECT d_key, machine_id, user_id, count(DISTINCT order_id) AS n, sum(origin_amount) AS g,
         sum(actual_amount) AS a
  FROM po WHERE pay_complete_time >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY ALL
), per_day AS (
  SELECT d.d_key, d.machine_id, sum(d.n) AS n, sum(d.g) AS g, sum(d.a) AS a,
         count(DISTINCT d.user_id) AS users,
         count(DISTINCT d.user_id) FILTER (WHERE d.d_key = u.rack_first_order) AS fresh
  FROM dmu d LEFT JOIN (SELECT user_id, rack_first_order FROM user_info WHERE pt = {AS_OF}) u
    ON u.user_id = d.user_id
  GROUP BY ALL
), cost AS (SELECT DISTINCT pt, machine_id, order_count, list_amount, sale_amount, moving_cost FROM rack_cost)
SELECT left(p.d_key, 6) AS month, p.machine_id, rk.machine_name, CAST(sum(p.n) AS BIGINT) AS order_qyt,
       CAST(sum(p.g) AS DOUBLE) AS ori, CAST(sum(p.a) AS DOUBLE) AS act,
       CAST(sum(cost.moving_cost) AS DOUBLE) AS moving_cost,
       CAST(sum(p.users) AS BIGINT) AS user_qyt, CAST(sum(p.fresh) AS BIGINT) AS new_user
FROM per_day p LEFT JOIN cost ON cost.pt = p.d_key AND cost.machine_id = p.machine_id
LEFT JOIN rk ON rk.machine_id = p.machine_id
GROUP BY ALL""",
    "order_detail": f"""
WITH named AS (
  SELECT rk.machine_id, rk.machine_name, h.total_people
  FROM rk JOIN headcount_detail h ON h.customer_id = rk.customer_id
  WHERE rk.machine_name IN ({NAMES})
)
SELECT i.machine_id, n.machine_name, n.total_people, i.order_id, CAST(o.origin_amount AS DOUBLE) AS origin_amount,
       strftime(i.pay_complete_time, '%Y-%m-%d %H:%M:%S') AS pay_complete_time, i.sku_id, i.commodity_name,
       CAST(i.commodity_origin_price AS DOUBLE) AS commodity_origin_price,
       CAST(i.commodity_sale_price AS DOUBLE) AS commodity_sale_price, i.quantity
FROM order_item i JOIN named n ON n.machine_id = i.machine_id JOIN po o ON o.order_id = i.order_id
WHERE i.pt = {AS_OF}""",
    "discounted_order_items": f"""
SELECT o.order_id, i.machine_id, i.user_id, i.sku_id, i.city_name, i.commodity_name,
       CAST(i.commodity_origin_price AS DOUBLE) AS commodity_origin_price,
       CAST(i.commodity_sale_price AS DOUBLE) AS commodity_sale_price, i.quantity, CAST(i.commodity_origin_price * i.quantity AS DOUBLE) AS origin_line,
       CAST(i.commodity_sale_price * i.quantity AS DOUBLE) AS sale_line, strftime(i.pay_complete_time, '%Y-%m-%d %H:%M:%S') AS pay_complete_time,
       i.pay_status, i.pt
FROM po o JOIN order_item i ON i.order_id = o.order_id AND i.pt = {AS_OF}
WHERE strftime(o.pay_complete_time, '%m') = '06' AND o.origin_amount > o.actual_amount""",
}


def _statement(q: str) -> str:
    q = q.strip()
    q = ("WITH " + BASE.strip() + ",\n" + q[5:]) if q.upper().startswith("WITH ") else ("WITH " + BASE.strip() + "\n" + q)
    return with_tables(q)


def _rows_of(names) -> str:
    """The number of rows of each named report."""
    def part(n):
        q = ORACLE[n].strip()
        return f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM ({q}) q_{n}"
    return " UNION ALL ".join(part(n) for n in names)


def oracle_sql() -> dict[str, str]:
    out = {k: _statement(v) for k, v in ORACLE.items()}
    for name, (same, _) in KEPT.items():
        out[name] = out[same] if same else _statement(_rows_of(sorted(DERIVED)))
    return out
