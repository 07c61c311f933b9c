"""From raw documents to packed training sequences: five stages of the corpus operators.

Each stage takes all that the stage before kept and is written as Parquet before the next one reads
it, so a lost executor costs one stage at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import base, best_fit_packing, line_dedup, minhash, quality_rules, substring_dedup


def _measured(df: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail or lose too much."""
    return _measured(quality_rules.filter_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go, and documents of which nothing is left."""
    return _measured(line_dedup.remove(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return _measured(substring_dedup.remove(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return best_fit_packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("substring_dedup", passages), ("packing", packing)]

#: SQL cannot express shingle sets with components nor BPE; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    work, docs = base.new_work(spark), base.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = base.materialize(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
