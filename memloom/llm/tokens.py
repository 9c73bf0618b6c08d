"""Token counts through a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import blocks, stored

CACHE_SCHEMA = "digest binary, n_tokens long, version string"


@functools.lru_cache(maxsize=2)
def _load(model: str):
    if model.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(model)
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def count_tokens(model: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library for ``model`` gives them, without added ones."""
    tokenizer = _load(model)
    if model.endswith(".json"):
        return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [len(x) for x in tokenizer.encode(texts, num_threads=1)]


def tokenizer_version(model: str) -> str:
    """Digest of the vocabulary file: another file never meets counts of this one."""
    with open(model, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content.  Null counts as empty; nothing else is changed,
    since any other change could change the count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def token_counts(docs: DataFrame, model: str, cache: str) -> DataFrame:
    """Number of tokens of every text, from the cache table at ``cache`` where it has it.

    Each distinct content that the cache lacks for this tokenizer version is encoded once
    and appended; then all documents meet the cache in one narrow join.  Copies within a
    task are left out before the shuffle, so one content that fills a third of all rows
    moves once a task.  The cache is a plain table partitioned by version: an append that
    was cut off and repeated adds equal rows, which the join takes as one.

    ``cache`` must lie in a folder that all executors share; it need not exist.  Null text
    counts as empty (0 tokens); repeated rows stay repeated; an empty table gives none.
    Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                        content_digest(F.col("text")).alias("digest"))
    encode_misses(keyed.select("digest", "text"), model, version, cache)
    counts = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(counts, "counts")  # a plain table: the join can split a content of many copies
    sizes = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Digests and counts stored for one tokenizer version; none where there is no cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).drop("version")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return rows.where(F.col("version") == version).drop("version")


def encode_misses(contents: DataFrame, model: str, version: str, cache: str) -> None:
    """Append the counts of those (digest, text) rows that the cache has not."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            new = [d not in seen and not seen.add(d) for d in digests]
            yield batch.filter(pa.array(new, pa.bool_()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(once(batches)):
            counts = count_tokens(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "n_tokens": pa.array(counts, pa.int64())})

    stored = read_cache(contents.sparkSession, cache, version).select("digest")
    misses = (
        contents.mapInArrow(once, "digest binary, text string")
        .repartition("digest")  # all copies of a content meet, also when the cache is small
        .join(stored, "digest", "left_anti")
        .mapInArrow(encode, "digest binary, n_tokens long")
    )
    misses.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
