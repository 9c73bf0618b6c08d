"""From documents to packed training sequences: language, quality, near-copies, leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import decontam, language, packing, quality, queries, similar
from memloom.llm.common import documents, stored
from memloom.session import configure


#: Bytes of an Arrow batch: the workers of five stages stay side by side in one executor.
BATCH_BYTES = "1m"


def _small_batches(spark: SparkSession) -> None:
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and those whose language stays unsure."""
    _small_batches(spark)
    model = language.learn(language.label_rows(docs))
    return language.keep_known(docs, model, queries.LANGUAGE_FLOOR)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what both views together take for bad."""
    _small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.QUALITY_FLOOR)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies: 0.8 of all five-word shingles or more."""
    _small_batches(spark)
    return similar.drop_similar(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a benchmark item."""
    _small_batches(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what was kept; one row for each piece of a document."""
    _small_batches(spark)
    return queries.packed_rows(packing.pack(docs, queries.byte_vocabulary(), queries.WINDOW, queries.END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-copies", one_of_each),
    ("decontamination", no_benchmark),
    ("packing", pack_sequences),
]

#: Learned models and tokenizers are not told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, written and read again in between."""
    docs = documents(spark, sf_dir)
    _small_batches(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
