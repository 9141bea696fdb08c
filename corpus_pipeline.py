"""Corpus preparation in five stages over ``documents``; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of their input. Every stage works on all rows that its predecessor kept;
null texts, repeated rows, empty tables and extra columns are treated as the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import table, written
from driftline.llm.decontamination import decontaminated
from driftline.llm.mixing import mixing
from driftline.llm.quality_fm import keep_good
from driftline.llm.secret_scan import redacted
from driftline.llm.simhash_dedup import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words of each document it takes."""
    return mixing(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("mixing", mix_sources)]

#: The classifier, the bit-parallel distance and the forest have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
