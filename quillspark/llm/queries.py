"""The registered queries of this subpackage and their SQL.

Each ``opN_<name>`` reads its whole table, applies its operator with production
parameters and derives the digest columns of its contract. Operators that SQL cannot
express have no entry in ``ORACLES``; tests/llm holds them against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat_format as chat
from quillspark.llm import embedding_dedup as embedding
from quillspark.llm import near_dedup as near
from quillspark.llm import bpe, packing, scratch, sharding, token_files, toxicity
from quillspark.llm import quality_rules as quality
from quillspark.llm import secret_scan as secrets


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted text."""
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chat(chat.format_chat(turns))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces of sequences of at most 2048 tokens."""
    pieces = packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to Simple-8b files and read back from them."""
    path = f"{scratch.root(spark)}/quill-token-files-{uuid.uuid4().hex}"
    token_files.write(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank file and decoded again."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.98 or more within its label."""
    return embedding.embedding_dedup(_read(spark, sf_dir, "embeddings"), 0.98)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five words, a similarity of 0.8 or more."""
    return near.near_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), 0.8)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "evidence_terms")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of equal row counts, equal texts together."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), 8)


QUERIES = {
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op6_token_files": op6_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_secret_scan": op10_secret_scan,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op1_toxicity": op1_toxicity,
    "op8_sharding": op8_sharding,
}
