"""Hand-made logical tables for edge-case tests."""

import datetime as dt
from decimal import Decimal

from rackpulse.operators.calendar import calendar
from rackpulse.sources.catalog import Catalog

AS_OF = "20171231"

SCHEMAS = {
    "rack_order": "order_id bigint, user_id bigint, machine_id bigint, city_name string, "
                  "pay_complete_time timestamp_ntz, pay_status int, origin_amount decimal(18,2), "
                  "actual_amount decimal(18,4), pt string",
    "rack": "machine_id bigint, machine_name string, customer_id bigint, machine_type int, machine_type_name string, "
            "machine_sub_type int, machine_sub_type_name string, address string, online_time timestamp_ntz, "
            "update_time timestamp_ntz, release_status int, city_name string, pt string",
    "company": "customer_id bigint, corp_name string, total_people string, pt string",
    "company_raw": "customer_id bigint, total_people string",
    "user_info": "user_id bigint, rack_first_order string, pt string",
    "rack_grade": "machine_id bigint, machine_grading string, pt string",
    "order_item": "order_id bigint, machine_id bigint, user_id bigint, sku_id bigint, city_name string, "
                  "commodity_name string, commodity_origin_price decimal(18,2), commodity_sale_price decimal(18,4), "
                  "quantity bigint, pay_complete_time timestamp_ntz, "
                  "pay_status int, pt string",
    "commodity": "sku_id bigint, commodity_name string, div_name string, dept_name string, class_name string, "
                 "subclass_name string, pt string",
    "rack_cost": "pt string, machine_id bigint, order_count bigint, list_amount decimal(18,2), "
                 "sale_amount decimal(18,4), moving_cost decimal(18,2)",
}


def ts(s):
    return dt.datetime.fromisoformat(s)


def D(x):
    return Decimal(str(x))


def order(order_id, user_id, machine_id, when, origin, actual, status=64, city="Shanghai", pt=AS_OF):
    return (order_id, user_id, machine_id, city, ts(when), status, D(origin), D(actual), pt)


def rack(machine_id, name, customer_id, status=2, city="Shanghai", pt=AS_OF, online="2017-01-01 00:00:00",
         update="2017-06-01 00:00:00", mtype=10, sub=10):
    return (machine_id, name, customer_id, mtype, "shelf", sub, "standard", "addr", ts(online) if online else None,
            ts(update) if update else None, status, city, pt)


def catalog(spark, start="2016-12-01", end="2018-01-31", **rows) -> Catalog:
    loaders = {}
    for name, schema in SCHEMAS.items():
        data = rows.get(name, [])
        loaders[name] = (lambda d=data, s=schema: spark.createDataFrame(d, s))
    loaders["calendar"] = lambda: calendar(spark, start, end)
    return Catalog(spark, loaders)
