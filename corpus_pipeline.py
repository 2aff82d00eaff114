"""The corpus pipeline: five stages from documents to training windows.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its result is written as Parquet
and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import common, exact_dedup, mixing, packing, quality_mil, queries, simhash
from loomtrace.plans import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; null, empty and blank texts go. Learnt from the labelled documents that are left."""
    return quality_mil.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the least id; rows equal in all columns leave one."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; texts without letters stay."""
    return simhash.simhash_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources, each as often as it is drawn; null branches are a branch of their own."""
    return mixing.mix(docs, queries.TREE)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over every token that is left; texts without words are in none."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixture), ("packing", windows)]

#: The classifier, the signatures and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    """The windows made of all of ``documents``. What a stage keeps is written to the shared folder and read from there."""
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
