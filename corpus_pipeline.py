"""The pipeline from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, decontam, minhash, pii, ppm
from siftline.llm.shared import drop_scratch, scratch, scratch_mark, sweep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels teach; those without a
    letter and those that no language's statistics fit are rejected."""
    return ppm.in_known_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one
    with the smallest id."""
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked; n_chars is that of the new text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the decoded text."""
    return bpe.round_trip(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: No stage but the masking can be said in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is deleted when
    its result is written or it fails, and that result when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        mark, done = scratch_mark(), []
        try:
            done = [scratch(stage(spark, docs, sf_dir), name)]
        finally:
            sweep(spark, mark, *done)
        drop_scratch(*before)
        docs, before = done[0], done
    return STAGES[-1][1](spark, docs, sf_dir)
