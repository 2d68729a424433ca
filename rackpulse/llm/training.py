"""Bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a training row's text that are learned from: a longer text gives a window of so many, at a place that its id decides.
#: Every text is scored whole, whatever its length.
MAX_BYTES = 20_000


def remainder(folds: int):
    """crc32 of doc_id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def held_out(folds: int, fold: int):
    return F.coalesce(remainder(folds) == fold, F.lit(False))


def sample_ids(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` ids of ``rows`` that come first in the order of their digests; the same at every run."""
    return rows.select("doc_id").where("doc_id is not null").distinct().orderBy(
        F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(size)


def window_start(length, size: int):
    """Where the window of ``size`` of a text of ``length`` starts, from 0."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.greatest(length - size + 1, F.lit(1)).cast("long")).cast("int")


def sample_texts(docs: DataFrame, ids: DataFrame, max_bytes: int = MAX_BYTES) -> list[bytes]:
    """The texts (of long ones a window) of the sampled ids, in the order of id and text. ``ids`` is bounded, so it is broadcast."""
    text = F.col("text").cast("binary")
    cut = F.substring(text, window_start(F.octet_length("text"), max_bytes) + 1, F.lit(max_bytes))
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", cut.alias("text")).toArrow()
    rows = zip(found.column("doc_id").to_pylist(), found.column("text").to_pylist(), strict=True)
    return [t for _, t in sorted(rows, key=lambda r: (r[0], r[1] or b"")) if t]
