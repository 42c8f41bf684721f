"""From raw documents to packed sequences: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.checkpoints import scratch_path
from strata.llm import decontaminate, lang_id, packing, quality, simhash
from strata.llm.samples import fold


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that is known; learned from the language column, never scored with it."""
    return lang_id.keep_identified(docs, lang_id.train(docs.where(fold("doc_id", 5) != 0)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of good quality, as the labels mark it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels, fold("doc_id", 5) != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("packing", packed)]

#: Tokenizers and trained models are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
