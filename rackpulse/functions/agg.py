"""Aggregation helpers that stay map-side combinable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_count(df: DataFrame, keys: list[str], col: str, alias: str) -> DataFrame:
    """``count(distinct col)`` per ``keys`` in two steps: de-duplicate ``(keys, col)`` (shuffled on
    all of them, so one hot key is spread over many tasks), then count values per key (partial
    aggregation before the shuffle, so a hot key sends one row per map task). Nulls are never
    counted; a group that holds only nulls stays, with 0. Without ``keys`` one row comes out."""
    return df.select(*keys, col).distinct().groupBy(*keys).agg(F.count(col).alias(alias))
