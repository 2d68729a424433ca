"""Exact distinct counts by bit sets: 64 ids a word, merged map-side by ``bit_or`` and counted by ``bit_count``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 6


def bit(at: Column) -> Column:
    """The word in which only bit ``at`` (0..63) is set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def has_bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftright", word, at.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def distinct_counts(df: DataFrame, keys: list[str], ids: Mapping[str, str], sums: Mapping[str, Column]) -> DataFrame:
    """Per ``keys``: ``sums`` (alias -> row value to sum) and, for each alias -> integer column of ``ids``, the number of
    distinct non-null values.

    Each id sets a bit of the word ``id >> 6`` of its kind, so what is shuffled is words: (keys, kind, word) with at most 64
    ids each, never one row per (keys, id), and a hot key is spread over its words. Ids may be sparse or negative: only
    words with a bit exist. The sums ride on the first kind's rows. Two shuffles, the second of words already summed map-side."""
    kinds = list(ids)
    each = [F.struct(F.lit(i).alias("_kind"), F.shiftright(F.col(ids[k]).cast("long"), WORD_BITS).alias("_word"),
                     bit(F.col(ids[k]).cast("long").bitwiseAND(F.lit(63).cast("long"))).alias("_bit"))
            for i, k in enumerate(kinds)]
    first = F.col("_id._kind") == 0
    rows = df.select(*keys, *[v.alias(f"_s{i}") for i, v in enumerate(sums.values())], F.explode(F.array(*each)).alias("_id"))
    words = rows.groupBy(*keys, F.col("_id._kind").alias("_kind"), F.col("_id._word").alias("_word")).agg(
        F.bit_or("_id._bit").alias("_bits"), *[F.sum(F.when(first, F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(sums))])
    held = F.coalesce(F.bit_count("_bits"), F.lit(0))
    return words.groupBy(*keys).agg(
        *[F.sum(f"_s{i}").alias(a) for i, a in enumerate(sums)],
        *[F.sum(F.when(F.col("_kind") == i, held).otherwise(0)).cast("long").alias(k) for i, k in enumerate(kinds)])
