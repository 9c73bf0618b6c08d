"""One query for each operator over the given tables, and SQL where it can tell the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import (decontam, language, lexical, licenses, maxscore, packing, perplexity, quality, sharding, simhash,
                         spelling, tokens, toxicity)
from memloom.llm.common import documents, held_out
from memloom.session import configure, shared_dir

#: The sequence length and the end id of the packing query and the pipeline.
WINDOW, END_ID = 2048, 1
#: Beliefs from which a document stays.
QUALITY_FLOOR, LANGUAGE_FLOOR = 0.3, 0.4


def byte_vocabulary() -> packing.Vocabulary:
    return packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(documents(spark, sf_dir), labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "content_score", "metadata_score",
        (F.col("score") >= QUALITY_FLOOR).alias("kept"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.learn(language.label_rows(docs))
    found = language.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/memloom-runs/{uuid.uuid4().hex}/token-cache"
    counts = tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("detections")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(packing.pack(documents(spark, sf_dir), byte_vocabulary(), WINDOW, END_ID))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(documents(spark, sf_dir))
    return lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    vectors = maxscore.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return maxscore.top_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


def packed_rows(packed: packing.Packed) -> DataFrame:
    """Where each piece went, with a digest of its ids."""
    pieces = packed.pieces.select("piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pieces.join(packed.plan, "piece").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_simhash, op4_benchmark_leaks, op5_token_counts,
                                   op6_byte_shards, op7_licenses, op8_toxicity, op9_packing, op10_quality_rules,
                                   op11_spelling, op12_ranked_search, op13_top_products)}
ORACLE: dict[str, str] = {"op4_benchmark_leaks": decontam.SQL, "op12_ranked_search": lexical.SQL,
                          "op13_top_products": maxscore.SQL}
