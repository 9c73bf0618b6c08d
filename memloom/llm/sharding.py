"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import cut_lineage

#: Bytes a document takes besides its text.
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """Cut all documents, ordered by text digest and id, into ``shards`` runs of equal bytes.

    Equal texts stand together in that order, so a group of copies is split only where a
    target falls into it.  Partitions are ranged and sorted once and pinned by a
    checkpoint; their totals (one row for each partition) give every partition its first
    byte and row, and a running sum inside does the rest.  A document belongs to the shard
    in whose target its middle byte lies, so a shard is off by at most one document.

    Null texts have no bytes but still the overhead; null ids, ties and repeated rows are
    ordinary rows; an empty table gives none.  Only ``doc_id`` and ``text`` are read.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),  # parts repeated rows
    )
    order = ["digest", "doc_id", "row_no"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pinned = cut_lineage(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).drop("digest", "row_no"),
        eager=True,
    )

    totals = pinned.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_row"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = row = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size").to_numpy()
            if byte is None:
                byte, row = batch.column("first_byte")[0].as_py(), batch.column("first_row")[0].as_py()
            ends = byte + np.cumsum(sizes)
            middle = 2 * ends - sizes  # twice the middle byte
            shard = np.minimum(middle * shards // (2 * batch.column("all_bytes").to_numpy()), shards - 1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "size": sizes, "text_crc32": batch.column("text_crc32"),
                "shard": pa.array(shard, pa.int32()), "place": row + np.arange(len(sizes)),
            })
            byte, row = int(ends[-1]), row + len(sizes)

    # the totals have a row for each partition, however many documents there are
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = pinned.join(F.broadcast(totals), "part").mapInArrow(
        place, f"doc_id {kind}, size long, text_crc32 long, shard int, place long")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
