"""Training-data pipeline over `documents`: quality, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from manuscribe.llm import decontam, minhash, packing, quality
from manuscribe.llm.common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows are decided by their own text: null ids, repeated rows, null, empty and
    very long texts alike. Without labels every score is the labels' share of
    ones, 0.5 if there is none, and all rows go. All columns stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group with 5-word shingle sets 80 % alike.

    Null and empty texts are like none and stay; null ids rank last; repeated
    rows stay or go together; texts are compared whole. All columns stay.
    """
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are decided by their own text, whatever their ids; null and empty texts
    stay, very long ones are searched whole, and an empty benchmark keeps all. All columns stay.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, in windows of 2,048 tokens.

    Null and empty texts have their end token; null ids and repeated rows are
    packed like others; very long texts are cut at windows. No columns but the pieces'.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: No SQL expresses the classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
