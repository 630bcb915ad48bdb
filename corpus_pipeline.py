"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; its decisions take
effect: quality rules, toxicity and near duplicates remove documents, the secret scan masks
what it finds, packing cuts the rest into sequences. All but the last return the columns of documents.

Null texts fail the quality rules, as empty ones do; repeated rows pass or fall alike; an
empty table stays empty through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import near_dedup, packing, quality_rules, scratch, secret_scan, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; labels of held-out documents are not used."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.drop_duplicates(docs).select(docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; ``n_chars`` follows the text."""
    safe = secret_scan.redact(secret_scan.scan_secrets(docs))
    return safe.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("toxicity", clean), ("near_dedup", distinct), ("secret_scan", masked), ("packing", packed)]

#: Toxicity, near duplicates and packing have no SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(spark, before)  # its successor is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
