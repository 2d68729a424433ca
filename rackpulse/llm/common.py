"""Helpers shared by the operators: shared storage, per-worker caches, table reading."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.session import checkpoint_dir

#: Words as the near-duplicate, mixing and decontamination operators take them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where it is unset is one made: a scratch folder in local mode, else a folder of the warehouse.
    """
    sc = spark.sparkContext
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        local = sc.master.startswith("local[") or sc.master == "local"
        root = tempfile.mkdtemp(prefix="rackpulse-") if local else spark.conf.get("spark.sql.warehouse.dir")
        return checkpoint_dir(spark, f"{root.rstrip('/')}/llm")
    return checkpoint_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage in a way that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that what Python makes of a batch of texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def worker_cache(key: str, build: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker process, built on first use."""
    home = sys.modules.setdefault("_rackpulse_worker_cache", types.ModuleType("_rackpulse_worker_cache"))
    if not hasattr(home, key):
        setattr(home, key, build())
    return getattr(home, key)


def shared_state(spark: SparkSession, model: object | None) -> Callable[[], object | None]:
    """``model`` for Python workers: its fields are broadcast (they must be plain values and arrays), its class travels with the
    function that calls the result, so workers need no copy of this package."""
    fields = spark.sparkContext.broadcast(None if model is None else vars(model))
    kind = type(model)

    def get() -> object | None:
        if fields.value is None:
            return None
        out = object.__new__(kind)
        out.__dict__.update(fields.value)
        return out

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body (or a lambda in it) refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it a name that no column of ``df`` has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
