"""The corpus pipeline: five stages, each reading what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislewise.llm import common, langid, near_copies, packing, quality, radix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest, calibrated on the labels."""
    return quality.filter_documents(docs, common.table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries come from labelled documents."""
    return langid.keep_clear(docs, langid.sample(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest doc_id; null texts are empty ones."""
    return radix_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are alike to 0.8 or more; op6 keeps its own contract."""
    return near_copies.one_of_each_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, every token of every document in one of them."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]
#: Isolation forests, zstandard and SimHash have no SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next stage."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
