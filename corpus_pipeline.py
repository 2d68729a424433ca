"""The corpus pipeline: quality, language, near duplicates, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and reads it
back as the next stage's documents. All stages but the last return the columns of documents.

Defined cases: a null or empty text scores as one for quality and goes with the texts without letters; rows that repeat id and text
are judged alike and stay once after the near duplicates; of equal texts the smallest id stays (null last); very long texts are read
whole by every stage; an empty table gives an empty mixture; further columns stay through all stages but the last, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import decontam, language, mixing, near, quality
from rackpulse.llm.common import free_name, store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores at its threshold or above. Its training rows come from ``documents``."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return quality.with_scores(docs, net, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those without letters are rejected, and those that take as many bits per letter
    in every language as foreign text does."""
    return language.in_a_language(docs, language.train(table(spark, sf_dir, "documents")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return near.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language identification", keep_language),
    ("near duplicates", keep_one),
    ("benchmark decontamination", keep_clean),
    ("source mixture", mix_sources),
]

#: The classifiers can't be expressed in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
