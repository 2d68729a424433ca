"""Sinks: rebuild a derived table (drop + create-as-select becomes one overwrite that survives failures)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.session import shared_dir
from rackpulse.sources.catalog import read_partitioned

#: Name of a whole table that was put aside.
_WHOLE = "_table"


def balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt out by ``keys`` in portions of even size: adaptive execution splits the rows of a large key over several
    tasks (and so files) and puts small keys together, by ``spark.sql.adaptive.advisoryPartitionSizeInBytes``."""
    names = ", ".join(f"`{k}`" for k in keys)
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({names}) */ * FROM {{rows}}", rows=df)


def materialise(df: DataFrame, name: str, root: str | None = None,
                partition_by: str | list[str] | None = None,
                bucket_by: tuple[int, list[str]] | None = None) -> str:
    """Write ``df`` as parquet table ``name`` under ``root`` (default: the session's shared
    ``spark.checkpoint.dir``) with overwrite semantics, and return the path.

    With ``partition_by`` only the partitions that ``df`` holds are replaced, so one day can be rebuilt beside the
    others; rows are dealt out in even portions, so a large partition has many writers and files. The new rows are
    written beside the table first. Then each folder (partition or table) is put aside, the new one takes its place and
    the old one goes; where a move fails, the old folder returns to its place. If the driver ends between two moves, the
    next ``materialise`` or ``recover`` puts the old folder back. Readers that must never see a table between
    two moves read a view: ``publish``.

    Writing is also how a long lineage is cut: a job reading the written table back restarts from
    it after an executor loss instead of recomputing the whole plan. ``bucket_by=(n, [cols])`` stores
    the table bucketed (and registers it as ``name`` in the session catalog) for co-located joins,
    e.g. the order-keyed tables on ``order_id``.
    """
    spark = df.sparkSession
    path = f"{(root or shared_dir(spark)).rstrip('/')}/{name}"
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if bucket_by:
        # bucketed tables live in the session catalog (path in the shared folder): two tables bucketed
        # the same way on their join key are joined without a shuffle
        n, cols = bucket_by
        writer = df.write.mode("overwrite")
        if keys:
            writer = writer.partitionBy(*keys)
        writer.bucketBy(n, *cols).sortBy(*cols).format("parquet").option("path", path).saveAsTable(name)
        return path
    recover(spark, path)
    fresh = f"{path}.new-{uuid.uuid4().hex[:8]}"
    if keys:
        balanced(df, keys).write.partitionBy(*keys).parquet(fresh)
    else:
        df.write.parquet(fresh)
    _replace(spark, fresh, path, len(keys))
    return path


def publish(df: DataFrame, name: str, root: str | None = None, partition_by: str | list[str] | None = None,
            keep: int = 2) -> str:
    """Write ``df`` as a new version of table ``name`` and point the catalog's view ``name`` at it: one change in the
    catalog, so readers see the old table or the new one and never none. Versions older than the last ``keep`` go; readers
    that began on the version before can finish. Returns the version's path."""
    spark = df.sparkSession
    base = f"{(root or shared_dir(spark)).rstrip('/')}/{name}"
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    fs, _ = _fs(spark, base)
    before = sorted((s.getModificationTime(), s.getPath().toString()) for s in _children(spark, fs, base)
                    if fs.exists(_path(spark, f"{s.getPath().toString()}/_SUCCESS")))  # complete ones
    path = f"{base}/v-{uuid.uuid4().hex[:12]}"
    writer = (balanced(df, keys) if keys else df).write
    try:
        (writer.partitionBy(*keys) if keys else writer).parquet(path)
    except BaseException:
        fs.delete(_path(spark, path), True)
        raise
    # partition keys read back as other types are cast, so the view has the types that were written
    columns = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in df.schema.fields)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{path}`")
    for _, old in before[:max(0, len(before) - keep + 1)]:
        fs.delete(_path(spark, old), True)
    return path


def drop(spark: SparkSession, name: str, root: str | None = None) -> bool:
    """Drop table ``name`` if it is there; whether it was. It is moved aside first, so no reader finds half a table."""
    path = f"{(root or shared_dir(spark)).rstrip('/')}/{name}"
    recover(spark, path)
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return False
    gone = _path(spark, f"{path}.gone-{uuid.uuid4().hex[:8]}")
    _move(fs, at, gone)
    fs.delete(gone, True)
    return True


def recover(spark: SparkSession, path: str) -> list[str]:
    """Put back the folders of a table that a rebuild which did not end had put aside; their paths."""
    fs, at = _fs(spark, path)
    back = []
    for aside in fs.globStatus(_path(spark, f"{path}.old-*")) or []:
        for part in _folders(spark, fs, aside.getPath(), None):
            tail = part.toString()[len(aside.getPath().toString()) + 1:]
            home = at if tail == _WHOLE else _path(spark, f"{path}/{tail}")
            if not fs.exists(home):
                fs.mkdirs(home.getParent())
                _move(fs, part, home)
                back.append(home.toString())
        fs.delete(aside.getPath(), True)
    return back


# ---- files

def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(_path(spark, path))  # as folders are listed


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from, each counted once (0: none, as for rows that come from the driver)."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)


def _children(spark: SparkSession, fs, path: str) -> list:
    at = _path(spark, path)
    return [s for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def _folders(spark: SparkSession, fs, at, depth: int | None) -> list:
    """The partition folders ``depth`` levels below ``at`` (None: as deep as ``key=value`` names go)."""
    if depth == 0:
        return [at]
    down = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and ("=" in s.getPath().getName()
                                                                          or s.getPath().getName() == _WHOLE)]
    if depth is None and not down:
        return [at]
    return [x for d in down for x in _folders(spark, fs, d, None if depth is None else depth - 1)]


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not move {source.toString()} to {target.toString()}")


def _replace(spark: SparkSession, fresh: str, path: str, depth: int) -> None:
    """Put the folders of the complete table ``fresh`` (itself, or its partitions ``depth`` levels down) in the place of those of
    ``path``."""
    fs, new = _fs(spark, fresh)
    if not fs.exists(_path(spark, path)):  # a new table: all of it at once
        depth = 0
    aside = f"{path}.old-{uuid.uuid4().hex[:8]}"
    for part in _folders(spark, fs, new, depth):
        tail = part.toString()[len(new.toString()) + 1:]
        home, old = _path(spark, f"{path}/{tail}" if depth else path), _path(spark, f"{aside}/{tail or _WHOLE}")
        had = fs.exists(home)
        if had:
            fs.mkdirs(old.getParent())
            _move(fs, home, old)
        else:
            fs.mkdirs(home.getParent())
        try:
            _move(fs, part, home)
        except BaseException:
            if had:
                _move(fs, old, home)
            raise
    for gone in (aside, fresh):
        fs.delete(_path(spark, gone), True)


def read_materialised(spark: SparkSession, path: str) -> DataFrame:
    return read_partitioned(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own under the shared one, and read back: a short lineage to restart from."""
    root = f"{shared_dir(df.sparkSession).rstrip('/')}/tables-{uuid.uuid4().hex[:8]}"
    return read_materialised(df.sparkSession, materialise(df, name, root))


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
