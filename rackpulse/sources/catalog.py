"""Logical-name table registry and the filters every report starts with.

Tables are daily full snapshots partitioned by a ``pt`` string key (``yyyyMMdd``), history tables keyed
by ``day_id``, or plain tables. Reports take a ``Catalog`` and the snapshot keys as parameters; the
filters below are plain ``where`` clauses, so on a ``partitionBy("pt")`` parquet table they become
``PartitionFilters`` and only the chosen snapshot folders are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAID = 64  # fixed value: pay_status of a completed payment

# Logical tables and the columns the reports use.
LOGICAL_TABLES = {
    "company_raw": "customer_id, total_people (free text)",
    "company": "customer_id, corp_name, total_people, pt",
    "rack": "machine_id, machine_name, customer_id, machine_type, machine_type_name, machine_sub_type, "
            "machine_sub_type_name, address, online_time, update_time, release_status, city_name, pt",
    "rack_grade": "machine_id, machine_grading, pt",
    "rack_order": "order_id, user_id, machine_id, city_name, pay_complete_time, pay_status, "
                  "origin_amount, actual_amount, pt",
    "order_item": "order_id, machine_id, user_id, sku_id, city_name, commodity_name, "
                  "commodity_origin_price, commodity_sale_price, quantity, "
                  "pay_complete_time, pay_status, pt",
    "coupon": "order_id, coupon_type, discount_amount",
    "commodity": "sku_id, commodity_name, div_name, dept_name, class_name, subclass_name, pt",
    "calendar": "day_id, day_type, monday_date, year_name_cn, week_of_year, month_short_id, month_id, year_id",
    "user_info": "user_id, rack_first_order (yyyyMMdd), pt",
    "stock": "machine_id, sku_id, max_inventory, is_valid",
    "stock_his": "machine_id, sku_id, max_inventory, is_valid, day_id",
    "supplier_product_his": "supplier_code, is_valid, day_id",
    "user_event": "create_time, token, user_id, app_name, page_name, log_type",
    "account_token": "token, user_id",
    "rack_cost": "pt, machine_id, order_count, list_amount, sale_amount, moving_cost",
    "trade_detail": "year, week_of_year, user_id, order_id, origin_amount",
    "user_first_day": "year, week_of_year, user_id",
}

# Columns that identify a row. The reports count rows where the key makes that a distinct count.
UNIQUE_KEYS = {
    "rack_order": ("pt", "order_id"), "user_info": ("pt", "user_id"), "rack": ("pt", "machine_id"),
    "company": ("pt", "customer_id"), "commodity": ("pt", "sku_id"), "calendar": ("day_id",),
}
# Keys of snapshot and history tables: partition folders, always strings.
PARTITION_KEYS = ("pt", "day_id", "payday", "load")


class Catalog:
    """Maps logical names to lazily built DataFrames (built once per catalog, never collected)."""

    def __init__(self, spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._loaders:
                raise KeyError(f"unknown logical table {name!r}")
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    __getitem__ = table

    def duplicate_keys(self, name: str) -> DataFrame:
        """The keys of ``UNIQUE_KEYS[name]`` that several rows hold, with their number (no row: the contract
        holds)."""
        keys = list(UNIQUE_KEYS[name])
        return self.table(name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")

    def check_keys(self, names: Iterable[str] | None = None) -> None:
        """Raise if a table that the catalog holds breaks its key contract; names the table and a few keys."""
        for name in names if names is not None else sorted(UNIQUE_KEYS.keys() & self._loaders.keys()):
            found = self.duplicate_keys(name).limit(5).collect()
            if found:
                raise ValueError(f"{name}: several rows share a key, e.g. {[r.asDict() for r in found]}")

    def names(self) -> list[str]:
        return sorted(self._loaders)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str,
                     names: Iterable[str] = LOGICAL_TABLES) -> "Catalog":
        """One parquet folder per logical table under ``root`` (``pt=`` / ``day_id=`` sub-folders allowed; their
        keys are read as strings, whatever the session infers)."""
        def loader(n):
            return lambda: read_partitioned(spark, f"{root}/{n}")
        return cls(spark, {n: loader(n) for n in names})

    @classmethod
    def from_tables(cls, spark: SparkSession, mapping: dict[str, str]) -> "Catalog":
        """Logical name -> metastore table name."""
        return cls(spark, {n: (lambda t=t: spark.table(t)) for n, t in mapping.items()})


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder with string partition keys."""
    found = spark.read.option("basePath", path).parquet(path).schema
    fixed = T.StructType([T.StructField(f.name, T.StringType() if f.name in PARTITION_KEYS else f.dataType, f.nullable)
                          for f in found.fields])
    return spark.read.schema(fixed).option("basePath", path).parquet(path)


def snapshot(df: DataFrame, as_of: str, column: str = "pt") -> DataFrame:
    """One daily snapshot. ``as_of`` is a ``yyyyMMdd`` string compared as a string (no cast)."""
    return df.where(F.col(column) == F.lit(str(as_of)))


def snapshot_range(df: DataFrame, first: str, last: str, column: str = "pt") -> DataFrame:
    """Snapshots ``first <= key <= last`` (fixed-width keys order like dates)."""
    return df.where(F.col(column).between(F.lit(str(first)), F.lit(str(last))))


def snapshot_in(df: DataFrame, keys: Iterable[str], column: str = "pt") -> DataFrame:
    return df.where(F.col(column).isin([str(k) for k in keys]))


def paid(df: DataFrame, status: int = PAID) -> DataFrame:
    """Only completed payments."""
    return df.where(F.col("pay_status") == F.lit(status))
