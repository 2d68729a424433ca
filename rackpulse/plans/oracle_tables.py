"""The fixture mapping written once more, independently, as DuckDB CTEs over the test tables.

``with_tables(sql)`` prefixes an oracle query with these CTEs; DuckDB skips the unused ones. The CTE
names are the logical table names of ``rackpulse.sources.catalog`` (``rack_order`` is the logical
order table; ``orders`` stays the raw test table).
"""

FIXTURE_CTES = r"""
supplier_city AS (
  SELECT s.s_suppkey AS machine_id, n.n_name AS city_name
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
),
item_lines AS (
  SELECT l.l_orderkey AS order_id, l.l_suppkey AS machine_id,
         CASE WHEN o.o_totalprice >= 10000 THEN o.o_custkey END AS user_id, l.l_partkey AS sku_id, sc.city_name, p.p_name AS commodity_name,
         CAST(p.p_retailprice AS DECIMAL(18,2)) AS commodity_origin_price,
         CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))
           AS commodity_sale_price,
         CAST(l.l_quantity AS BIGINT) AS quantity,
         o.o_orderdate AS pay_complete_time,
         CASE WHEN o.o_orderstatus = 'F' THEN 64 ELSE 0 END AS pay_status
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier_city sc ON l.l_suppkey = sc.machine_id
),
order_item AS (
  SELECT i.*, s.pt FROM item_lines i
  JOIN (VALUES ('20011231'), ('19991231')) s(pt) ON strftime(i.pay_complete_time, '%Y%m%d') <= s.pt
),
order_sums AS (
  SELECT order_id, min(machine_id) AS machine_id,
         sum(CAST(commodity_origin_price * quantity AS DECIMAL(18,2))) AS list,
         sum(CAST(commodity_sale_price * quantity AS DECIMAL(18,4))) AS paid
  FROM item_lines GROUP BY order_id
),
rack_order AS (
  SELECT o.o_orderkey AS order_id, CASE WHEN o.o_totalprice >= 10000 THEN o.o_custkey END AS user_id, t.machine_id, c.city_name,
         o.o_orderdate AS pay_complete_time, CASE WHEN o.o_orderstatus = 'F' THEN 64 ELSE 0 END AS pay_status,
         CAST(coalesce(t.list, CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS origin_amount,
         CAST(coalesce(t.paid, CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS actual_amount, s.pt
  FROM orders o LEFT JOIN order_sums t ON t.order_id = o.o_orderkey
  LEFT JOIN supplier_city c ON c.machine_id = t.machine_id
  JOIN (VALUES ('20011231'), ('19991231')) s(pt) ON strftime(o.o_orderdate, '%Y%m%d') <= s.pt
),
ship_span AS (
  SELECT l_suppkey, min(l_shipdate) AS online_time, max(l_shipdate) AS update_time
  FROM lineitem GROUP BY l_suppkey
),
headcount AS (
  SELECT c_custkey AS customer_id, c_name AS corp_name,
         CASE WHEN c_acctbal < 0 THEN NULL
              WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(hc AS VARCHAR)
              WHEN c_mktsegment = 'BUILDING' THEN CAST(hc AS VARCHAR) || '+'
              WHEN c_mktsegment = 'FURNITURE' THEN CAST(hc AS VARCHAR) || '人'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN '+' || CAST(hc AS VARCHAR)
              WHEN hc < 100 THEN ''
              WHEN hc < 200 THEN ' '
              WHEN hc < 300 THEN '30~50'
              WHEN hc < 400 THEN 'unknown'
              ELSE CAST(hc AS VARCHAR) || '人' END AS total_people
  FROM (SELECT *, CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS hc FROM customer)
),
first_buyer AS (
  SELECT l_suppkey, o_custkey AS own FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderdate, o_orderkey) = 1
),
blank_customers AS (
  SELECT c_custkey, n_regionkey, CASE WHEN n_regionkey IN (0, 1) THEN 'west' ELSE 'east' END AS half
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN headcount ON customer_id = c_custkey
  WHERE total_people = ''
),
rack_company AS (
  SELECT s.s_suppkey AS machine_id,
         coalesce(CASE WHEN s.s_acctbal >= 6500 THEN (SELECT min(b.c_custkey) FROM blank_customers b
                           WHERE b.half = CASE WHEN n.n_regionkey IN (0, 1) THEN 'west' ELSE 'east' END)
                       WHEN s.s_acctbal >= 3000 THEN (SELECT min(b.c_custkey) FROM blank_customers b
                           WHERE b.n_regionkey = n.n_regionkey) END, f.own) AS customer_id
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN first_buyer f ON f.l_suppkey = s.s_suppkey
),
rack_attr AS (
  SELECT s.s_suppkey AS machine_id, s.s_name AS machine_name, CAST(rc.customer_id AS BIGINT) AS customer_id,
         CASE WHEN s.s_acctbal < 2000 THEN 20 ELSE 10 END AS machine_type,
         CASE WHEN s.s_acctbal < 2000 THEN 'fridge' ELSE 'shelf' END AS machine_type_name,
         CASE WHEN s.s_acctbal < 1000 THEN 90 ELSE 10 END AS machine_sub_type,
         CASE WHEN s.s_acctbal < 1000 THEN 'hot' ELSE 'standard' END AS machine_sub_type_name,
         n.n_name || ' / ' || s.s_name AS address,
         sp.online_time, sp.update_time,
         CASE WHEN s.s_acctbal < 3000 THEN 2 WHEN s.s_acctbal < 6000 THEN 3 ELSE -1 END AS release_status,
         n.n_name AS city_name
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN rack_company rc ON rc.machine_id = s.s_suppkey
  LEFT JOIN ship_span sp ON sp.l_suppkey = s.s_suppkey
),
rack AS (
  SELECT *, '20011231' AS pt FROM rack_attr
  UNION ALL
  SELECT a.*, d.pt
  FROM (SELECT DISTINCT strftime(l_shipdate, '%Y%m%d') AS pt, l_suppkey FROM lineitem) d
  JOIN rack_attr a ON a.machine_id = d.l_suppkey
),
company AS (SELECT customer_id, corp_name, total_people, '20011231' AS pt FROM headcount),
company_raw AS (SELECT customer_id, total_people FROM headcount),
commodity AS (
  SELECT p_partkey AS sku_id, p_name AS commodity_name, p_brand AS div_name, p_type AS dept_name,
         CAST(p_size AS VARCHAR) AS class_name, p_name AS subclass_name, '20011231' AS pt
  FROM part
),
coupon AS (
  SELECT l_orderkey AS order_id,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 WHEN 'N' THEN 3 END AS coupon_type,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))
           AS discount_amount
  FROM lineitem
),
calendar AS (
  SELECT strftime(d, '%Y%m%d') AS day_id,
         CASE WHEN isodow(d) <= 5 THEN '工作日' ELSE '休息日' END AS day_type,
         CAST(date_trunc('week', d) AS DATE) AS monday_date,
         CAST(isoyear(d) AS VARCHAR) || '年' AS year_name_cn,
         CAST(week(d) AS INTEGER) AS week_of_year,
         CAST(month(d) AS INTEGER) AS month_short_id,
         strftime(d, '%Y%m') AS month_id,
         CAST(year(d) AS INTEGER) AS year_id
  FROM (SELECT CAST(range AS DATE) AS d
        FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY))
),
user_info AS (
  SELECT user_id, min(strftime(pay_complete_time, '%Y%m%d')) AS rack_first_order, '20011231' AS pt
  FROM rack_order WHERE pay_status = 64 AND pt = '20011231' GROUP BY user_id
),
stock AS (
  SELECT DISTINCT l_suppkey AS machine_id, l_partkey AS sku_id, CAST(p_size AS BIGINT) AS max_inventory,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_valid
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
stock_his AS (
  SELECT DISTINCT l_suppkey AS machine_id, l_partkey AS sku_id, CAST(p_size AS BIGINT) AS max_inventory,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_valid,
         strftime(l_shipdate, '%Y%m%d') AS day_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
supplier_product_his AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS supplier_code,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_valid,
         strftime(l_shipdate, '%Y%m%d') AS day_id
  FROM lineitem
),
rack_grade AS (
  SELECT machine_id,
         CASE release_status WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN -1 THEN 'C' END AS machine_grading, pt
  FROM rack
),
rack_cost AS (
  SELECT strftime(o.o_orderdate, '%Y%m%d') AS pt, l.l_suppkey AS machine_id,
         count(DISTINCT l.l_orderkey) AS order_count,
         sum(CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * CAST(l.l_quantity AS BIGINT) AS DECIMAL(18,2))) AS list_amount,
         sum(CAST(CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
                       AS DECIMAL(18,4)) * CAST(l.l_quantity AS BIGINT) AS DECIMAL(18,4))) AS sale_amount,
         sum(CAST(l.l_quantity AS DECIMAL(18,0)) * CAST(p.p_retailprice AS DECIMAL(18,2))) AS moving_cost
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2
),
trade_detail AS (
  SELECT CAST(isoyear(pay_complete_time) AS INTEGER) AS year,
         CAST(week(pay_complete_time) AS INTEGER) AS week_of_year,
         user_id, order_id, origin_amount
  FROM rack_order WHERE pay_status = 64 AND pt = '20011231'
),
user_first_day AS (
  SELECT CAST(isoyear(t) AS INTEGER) AS year, CAST(week(t) AS INTEGER) AS week_of_year, user_id
  FROM (SELECT user_id, min(pay_complete_time) AS t FROM rack_order WHERE pay_status = 64 AND pt = '20011231' GROUP BY user_id)
),
user_event AS (
  SELECT ts AS create_time, CAST(user_id AS VARCHAR) AS token, user_id, 'app-openrack-h5' AS app_name,
         CASE WHEN event_type = 'view' THEN 'commodity_list' ELSE event_type END AS page_name,
         CASE WHEN event_type IN ('view', 'click') THEN 'pv' ELSE 'event' END AS log_type
  FROM events
),
account_token AS (SELECT CAST(c_custkey AS VARCHAR) AS token, c_custkey AS user_id FROM customer)
"""


def with_tables(query: str) -> str:
    """``query`` may start with its own ``WITH``-less CTE list via ``, name AS (...)`` blocks:
    pass the final statement; extra CTEs go in front of it as ``<ctes> SELECT ...``."""
    q = query.strip()
    if q.upper().startswith("WITH "):
        return "WITH " + FIXTURE_CTES.strip() + ",\n" + q[5:]
    return "WITH " + FIXTURE_CTES.strip() + "\n" + q
