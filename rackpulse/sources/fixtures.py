"""Adapter: the supplied TPC-H-like test tables -> the logical tables of ``catalog.LOGICAL_TABLES``.

Every logical table is derived by Spark from the test tables, so its size grows with them:

* ``order_item``: ``lineitem`` joined to ``orders`` (order, buyer, time, status), ``part`` (name, unit price) and
  the supplier's nation (city). A supplier is a rack, a customer is a buyer, a part is a SKU. The unit prices are
  exact decimals: the part's retail price, and that less the line's discount.
* ``rack_order``: price x quantity of an order's lines, summed before joining ``orders``; an order without lines has
  its total price, no rack and no city. The facts have two snapshots, at ``AS_OF`` and, of the orders up to then,
  at ``EARLIER``.
* ``rack``: one full snapshot of all racks at ``AS_OF`` plus one daily snapshot per ship day holding
  the racks that shipped that day. The company of a rack is the buyer of the rack's first order; racks of suppliers
  with a balance from ``SITE_FROM`` on stand at a site: that of their region or, from ``CAMPUS_FROM`` on, of their
  half of the regions. A site's company is the first customer there whose headcount text is blank.
* ``company`` / ``company_raw``: every customer, with a free-text headcount derived from the account
  balance and market segment so that every parsing case occurs.
* the remaining tables as listed in FIXTURES.md.

Money is exact: line amounts are ``decimal(18,2)`` / ``decimal(18,4)``, summed exactly and turned
into double only in report output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.dates import day_key, iso_week, iso_year
from rackpulse.operators.calendar import calendar
from rackpulse.sources.catalog import PARTITION_KEYS, PAID, Catalog, read_partitioned, snapshot

# ---- fixed values: the mapping of the test tables onto the rack model ----
AS_OF = "20011231"               # key of the full snapshot (after the last ship day)
CAL_START, CAL_END = "1995-01-01", "2001-12-31"
PAID_ORDER_STATUS = "F"          # o_orderstatus of a paid order
RACK_TYPE_FRIDGE_BELOW = 2000.0  # s_acctbal below: machine_type 20 'fridge', else 10 'shelf'
RACK_HOT_BELOW = 1000.0          # s_acctbal below: machine_sub_type 90 'hot', else 10 'standard'
RACK_STATUS_EDGES = (3000.0, 6000.0)  # s_acctbal < 3000 -> status 2, < 6000 -> 3, else -1
COUPON_TYPES = {"A": 1, "R": 2, "N": 3}  # l_returnflag -> coupon_type
GRADE_BY_STATUS = {2: "A", 3: "B", -1: "C"}
APP_NAME, PAGE_NAME, PV = "app-openrack-h5", "commodity_list", "pv"
ANONYMOUS_BELOW = 10000.0        # o_totalprice below: the buyer is unknown
EARLIER = "19991231"             # key of the earlier snapshot of the facts
SITE_FROM, CAMPUS_FROM, WEST_REGIONS = 3000.0, 6500.0, (0, 1)
# ---- end of fixed values ----


def _money2(c):
    return F.col(c).cast("decimal(18,2)")


def fixture_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    frames: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    def with_city(rows: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with the city of their ``machine_id``. The two small tables are joined one by one: each is known to be small,
        their join is not, and for that the rows would be shuffled by rack."""
        s, n = raw("supplier"), raw("nation")
        at = s.select(F.col("s_suppkey").alias("machine_id"), "s_nationkey")
        city = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city_name"))
        return rows.join(at, "machine_id", how).join(city, "s_nationkey", how)

    def origin_price():
        return _money2("p_retailprice")

    def sale_price():
        return (origin_price() * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")

    def amount(price, kind: str):
        return (price * F.col("l_quantity").cast("decimal(12,0)")).cast(kind)

    def buyer():
        return F.when(F.col("o_totalprice") >= ANONYMOUS_BELOW, F.col("o_custkey"))

    def snapshots(df: DataFrame) -> DataFrame:
        """All orders at ``AS_OF``; those up to then at ``EARLIER``."""
        day = day_key("pay_complete_time")
        return df.withColumn("pt", F.lit(AS_OF)).unionByName(
            df.where(day <= EARLIER).withColumn("pt", F.lit(EARLIER)))

    def pay_status():
        return F.when(F.col("o_orderstatus") == PAID_ORDER_STATUS, F.lit(PAID)).otherwise(F.lit(0))

    def order_item() -> DataFrame:
        li, o, p = raw("lineitem"), raw("orders"), raw("part")
        # the orders last: the finished rows lie by order then, as facts stored by order need them
        lines = with_city(li.join(p, li.l_partkey == p.p_partkey).withColumnRenamed("l_suppkey", "machine_id"))
        return snapshots(
            lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("l_orderkey").alias("order_id"), "machine_id",
                        buyer().alias("user_id"), F.col("l_partkey").alias("sku_id"),
                        "city_name", F.col("p_name").alias("commodity_name"),
                        origin_price().alias("commodity_origin_price"), sale_price().alias("commodity_sale_price"),
                        F.col("l_quantity").cast("bigint").alias("quantity"),
                        F.col("o_orderdate").alias("pay_complete_time"),
                        pay_status().alias("pay_status")))

    def rack_order() -> DataFrame:
        li, o, p = raw("lineitem"), raw("orders"), raw("part")
        per_order = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("machine_id"),
            F.sum(amount(origin_price(), "decimal(18,2)")).cast("decimal(18,2)").alias("list"),
            F.sum(amount(sale_price(), "decimal(18,4)")).cast("decimal(18,4)").alias("paid"))
        total = _money2("o_totalprice")
        return snapshots(
            with_city(o.join(per_order, per_order.l_orderkey == o.o_orderkey, "left"), "left")
                .select(F.col("o_orderkey").alias("order_id"), buyer().alias("user_id"),
                        "machine_id", "city_name", F.col("o_orderdate").alias("pay_complete_time"),
                        pay_status().alias("pay_status"), F.coalesce("list", total).alias("origin_amount"),
                        F.coalesce("paid", total.cast("decimal(18,4)")).alias("actual_amount")))

    def rack_company() -> DataFrame:
        """(machine_id, customer_id)"""
        s, n, c, li, o = raw("supplier"), raw("nation"), raw("customer"), raw("lineitem"), raw("orders")
        first = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey")
                 .agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_custkey"))["o_custkey"].alias("own")))
        half = F.when(F.col("n_regionkey").isin(list(WEST_REGIONS)), "west").otherwise("east")
        blank = (c.where(headcount_text() == "").join(n, c.c_nationkey == n.n_nationkey)
                 .select("c_custkey", "n_regionkey", half.alias("half")))
        sites = blank.groupBy("n_regionkey").agg(F.min("c_custkey").alias("site"))
        campuses = blank.groupBy("half").agg(F.min("c_custkey").alias("campus"))
        bal = F.col("s_acctbal")
        at = (s.join(n, s.s_nationkey == n.n_nationkey).withColumn("half", half)
              .join(sites, "n_regionkey", "left").join(campuses, "half", "left")
              .join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left"))
        site = F.when(bal >= CAMPUS_FROM, F.col("campus")).when(bal >= SITE_FROM, F.col("site"))
        return at.select(F.col("s_suppkey").alias("machine_id"), F.coalesce(site, "own").alias("customer_id"))

    def rack_attr() -> DataFrame:
        s, n, li = raw("supplier"), raw("nation"), raw("lineitem")
        span = li.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("online_time"),
                                           F.max("l_shipdate").alias("update_time"))
        bal = F.col("s_acctbal")
        fridge = bal < RACK_TYPE_FRIDGE_BELOW
        hot = bal < RACK_HOT_BELOW
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .join(span, s.s_suppkey == span.l_suppkey, "left")
                .join(rack_company().withColumnRenamed("machine_id", "m"), F.col("s_suppkey") == F.col("m"))
                .select(F.col("s_suppkey").alias("machine_id"), F.col("s_name").alias("machine_name"),
                        F.col("customer_id").cast("bigint").alias("customer_id"),
                        F.when(fridge, 20).otherwise(10).alias("machine_type"),
                        F.when(fridge, "fridge").otherwise("shelf").alias("machine_type_name"),
                        F.when(hot, 90).otherwise(10).alias("machine_sub_type"),
                        F.when(hot, "hot").otherwise("standard").alias("machine_sub_type_name"),
                        F.concat(F.col("n_name"), F.lit(" / "), F.col("s_name")).alias("address"),
                        "online_time", "update_time",
                        F.when(bal < RACK_STATUS_EDGES[0], 2).when(bal < RACK_STATUS_EDGES[1], 3)
                        .otherwise(-1).alias("release_status"),
                        F.col("n_name").alias("city_name")))

    def rack() -> DataFrame:
        attr = rack_attr()
        li = raw("lineitem")
        full = attr.withColumn("pt", F.lit(AS_OF))
        days = li.select(day_key("l_shipdate").alias("pt"), F.col("l_suppkey").alias("machine_id")).distinct()
        daily = days.join(attr, "machine_id").select(*full.columns)
        return full.unionByName(daily)

    def headcount_text():
        hc = F.floor(F.abs(F.col("c_acctbal")) / 10).cast("bigint").cast("string")
        seg = F.col("c_mktsegment")
        n = F.floor(F.abs(F.col("c_acctbal")) / 10)
        return (F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
                .when(seg == "AUTOMOBILE", hc)
                .when(seg == "BUILDING", F.concat(hc, F.lit("+")))
                .when(seg == "FURNITURE", F.concat(hc, F.lit("人")))
                .when(seg == "HOUSEHOLD", F.concat(F.lit("+"), hc))
                .when(n < 100, F.lit(""))
                .when(n < 200, F.lit(" "))
                .when(n < 300, F.lit("30~50"))
                .when(n < 400, F.lit("unknown"))
                .otherwise(F.concat(hc, F.lit("人"))))

    def company() -> DataFrame:
        return raw("customer").select(F.col("c_custkey").alias("customer_id"),
                                      F.col("c_name").alias("corp_name"),
                                      headcount_text().alias("total_people"), F.lit(AS_OF).alias("pt"))

    def company_raw() -> DataFrame:
        return raw("customer").select(F.col("c_custkey").alias("customer_id"),
                                      headcount_text().alias("total_people"))

    def commodity() -> DataFrame:
        return raw("part").select(F.col("p_partkey").alias("sku_id"), F.col("p_name").alias("commodity_name"),
                                  F.col("p_brand").alias("div_name"), F.col("p_type").alias("dept_name"),
                                  F.col("p_size").cast("string").alias("class_name"),
                                  F.col("p_name").alias("subclass_name"), F.lit(AS_OF).alias("pt"))

    def coupon() -> DataFrame:
        ctype = F.col("l_returnflag")
        expr = None
        for flag, t in COUPON_TYPES.items():
            expr = F.when(ctype == flag, t) if expr is None else expr.when(ctype == flag, t)
        return raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), expr.alias("coupon_type"),
            (_money2("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)"))
            .cast("decimal(18,4)").alias("discount_amount"))

    def paid_now() -> DataFrame:
        return snapshot(cat.table("rack_order"), AS_OF).where(F.col("pay_status") == PAID)

    def user_info() -> DataFrame:
        return (paid_now().groupBy("user_id").agg(F.min(day_key("pay_complete_time")).alias("rack_first_order"))
                .withColumn("pt", F.lit(AS_OF)))

    def valid():
        return F.when(F.col("l_linestatus") == "O", 1).otherwise(0)

    def stock() -> DataFrame:
        li, p = raw("lineitem"), raw("part")
        return (li.join(p, li.l_partkey == p.p_partkey)
                .select(F.col("l_suppkey").alias("machine_id"), F.col("l_partkey").alias("sku_id"),
                        F.col("p_size").cast("bigint").alias("max_inventory"), valid().alias("is_valid"))
                .distinct())

    def stock_his() -> DataFrame:
        li, p = raw("lineitem"), raw("part")
        return (li.join(p, li.l_partkey == p.p_partkey)
                .select(F.col("l_suppkey").alias("machine_id"), F.col("l_partkey").alias("sku_id"),
                        F.col("p_size").cast("bigint").alias("max_inventory"), valid().alias("is_valid"),
                        day_key("l_shipdate").alias("day_id"))
                .distinct())

    def supplier_product_his() -> DataFrame:
        return (raw("lineitem")
                .select(F.col("l_suppkey").cast("string").alias("supplier_code"), valid().alias("is_valid"),
                        day_key("l_shipdate").alias("day_id"))
                .distinct())

    def rack_grade() -> DataFrame:
        st = F.col("release_status")
        expr = None
        for status, g in GRADE_BY_STATUS.items():
            expr = F.when(st == status, g) if expr is None else expr.when(st == status, g)
        return cat.table("rack").select("machine_id", expr.alias("machine_grading"), "pt")

    def rack_cost() -> DataFrame:
        li, o, p = raw("lineitem"), raw("orders"), raw("part")
        return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
                .groupBy(day_key("o_orderdate").alias("pt"), F.col("l_suppkey").alias("machine_id"))
                .agg(F.countDistinct("l_orderkey").alias("order_count"),
                     F.sum(amount(origin_price(), "decimal(18,2)")).alias("list_amount"),
                     F.sum(amount(sale_price(), "decimal(18,4)")).alias("sale_amount"),
                     F.sum(F.col("l_quantity").cast("decimal(18,0)") * _money2("p_retailprice"))
                     .alias("moving_cost")))

    def trade_detail() -> DataFrame:
        t = "pay_complete_time"
        return paid_now().select(iso_year(t).alias("year"), iso_week(t).alias("week_of_year"), "user_id", "order_id",
                                 "origin_amount")

    def user_first_day() -> DataFrame:
        first = paid_now().groupBy("user_id").agg(F.min("pay_complete_time").alias("t"))
        return first.select(iso_year("t").alias("year"), iso_week("t").alias("week_of_year"), "user_id")

    def user_event() -> DataFrame:
        et = F.col("event_type")
        return raw("events").select(
            F.col("ts").alias("create_time"), F.col("user_id").cast("string").alias("token"), "user_id",
            F.lit(APP_NAME).alias("app_name"),
            F.when(et == "view", F.lit(PAGE_NAME)).otherwise(et).alias("page_name"),
            F.when(et.isin("view", "click"), F.lit(PV)).otherwise(F.lit("event")).alias("log_type"))

    def account_token() -> DataFrame:
        return raw("customer").select(F.col("c_custkey").cast("string").alias("token"),
                                      F.col("c_custkey").alias("user_id"))

    loaders = {
        "order_item": order_item, "rack_order": rack_order, "rack": rack, "company": company,
        "company_raw": company_raw, "commodity": commodity, "coupon": coupon,
        "calendar": lambda: calendar(spark, CAL_START, CAL_END), "user_info": user_info,
        "stock": stock, "stock_his": stock_his, "supplier_product_his": supplier_product_his,
        "rack_grade": rack_grade, "rack_cost": rack_cost, "trade_detail": trade_detail,
        "user_first_day": user_first_day, "user_event": user_event, "account_token": account_token,
    }
    cat = Catalog(spark, loaders)
    cat.as_of = AS_OF
    return cat


#: Tables with a snapshot per day: some 2,500 folders each on the test tables.
DAILY_TABLES = ("rack", "rack_grade", "stock_his", "supplier_product_his", "rack_cost")


def materialise_catalog(spark: SparkSession, sf_dir: str, root: str, daily_folders: bool = False) -> Catalog:
    """Write every logical table of the fixture once (parquet under ``root``, a shared folder such as
    ``spark.checkpoint.dir``) and return a catalog reading the written tables, the way the reports
    read stored warehouse tables. Snapshot tables are partitioned by ``pt``, so a snapshot filter prunes folders.
    Those with a snapshot per day are only with ``daily_folders``, as a warehouse has them; else they are sorted by
    the key, so that the filter skips row groups (thousands of tiny files take a local disk minutes to write).
    The key contracts of the written tables are checked."""
    from rackpulse.sources.sinks import materialise

    lazy = fixture_catalog(spark, sf_dir)
    first = ["rack_order", "rack"]   # other tables are derived from these two: build those from the copies
    for name in first + [n for n in lazy.names() if n not in first]:
        df = lazy.table(name)
        # the calendar's day_id is a column, not a history key: one small file, not a folder per day
        key = next((k for k in PARTITION_KEYS if k in df.columns and name != "calendar"), None)
        if key and name in DAILY_TABLES and not daily_folders:
            df, key = df.sortWithinPartitions(key), None
        path = materialise(df, name, root, partition_by=key)
        if name in first:
            lazy._loaders[name] = (lambda p=path: read_partitioned(spark, p))
            lazy._frames.pop(name, None)
    cat = Catalog.from_parquet(spark, root, lazy.names())
    cat.as_of = AS_OF
    cat.check_keys()
    return cat
