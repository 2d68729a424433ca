"""Spark session settings the operators rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for the semantics or the plan shape of the operators.
SESSION_CONF = {
    # ANSI on: a bad cast or a division by zero raises instead of silently giving null;
    # the operators use try_cast / try_divide where the reports expect null.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # daily snapshot keys (pt='yyyyMMdd') must stay strings when read from partition folders
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # adaptive execution: coalesce small shuffle partitions, split skewed join partitions,
    # and switch sort-merge joins to broadcast joins when a side turns out small at run time
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # a selective join side (e.g. a short list of racks) pre-filters the big side with a bloom filter
    # before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = "local[*]", app: str = "rackpulse",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with ``SESSION_CONF``.

    ``shuffle_partitions`` is the initial partition count of every exchange; AQE coalesces it at
    run time. On a cluster pass a value sized to the data (about input bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def conf_of(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session with other ``settings`` for the jobs that are run inside; those before return, also after an error."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for checkpoints and materialised tables.

    Reads ``spark.checkpoint.dir`` from the session (set by the cluster). Only when it is unset
    (local tests) is ``fallback`` installed as the checkpoint directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set and no fallback was given")
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset one is made: a scratch
    folder in local mode, else a folder of the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return checkpoint_dir(spark)
    local = sc.master == "local" or sc.master.startswith("local[")
    root = tempfile.mkdtemp(prefix="rackpulse-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return checkpoint_dir(spark, f"{root.rstrip('/')}/shared")
