"""Deltas judged and logged as they arrive (ST1, ST2); record feeds (ST3).

A feed is plain Parquet: the records and sequences it starts from, and a log with a folder
for each micro-batch.  A batch is judged by what stood before it and writes its folder in
one job, so a batch that runs again writes the same rows again.  Records are the base with
the accepted entries of the log, folded by :func:`apply_deltas`; :func:`fold_feed` makes
that the base of a new feed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.delta import apply_deltas
from memloom.schemas import ORD
from memloom.sources.archives import records_of_lines, text_lines

_HEAD = ["agent_id", "base_sequence", "delta_seq"]
#: Batch number of what a feed starts with.
START = -1


@dataclass(frozen=True)
class Feed:
    """The folders of a feed: ``base``, ``sequences``, ``start`` and ``log/batch=N``."""

    spark: SparkSession
    path: str

    def log(self) -> DataFrame | None:
        """Every entry with the ``verdict`` on its delta and whether it ``waits``."""
        try:
            return self.spark.read.parquet(f"{self.path}/log")
        except AnalysisException as problem:
            if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None  # no batch yet
            raise

    def start(self) -> int:
        """Last batch that the base holds already."""
        return self.spark.read.parquet(f"{self.path}/start").first().batch

    def last_batch(self) -> int | None:
        log = self.log()
        return None if log is None else log.agg(F.max("batch")).first()[0]

    def records(self) -> DataFrame:
        """The record list as the log leaves it."""
        base, log = self.spark.read.parquet(f"{self.path}/base"), self.log()
        return base if log is None else apply_deltas(base, log.where("verdict = 'accept'"))

    def sequences(self, before: int | None = None) -> DataFrame:
        """Last accepted sequence of each agent, or the one ``before`` a batch."""
        rows = self.spark.read.parquet(f"{self.path}/sequences")
        log = self.log()
        if log is not None:
            taken = log.where("verdict = 'accept'")
            if before is not None:
                taken = taken.where(F.col("batch") < before)
            rows = rows.unionByName(taken.select("agent_id", F.col("delta_seq").cast("bigint").alias("last_sequence")))
        return rows.groupBy("agent_id").agg(F.max("last_sequence").alias("last_sequence"))

    def rejects(self) -> DataFrame | None:
        """Every delta refused so far, with its reason and batch."""
        log = self.log()
        return None if log is None else log.where("verdict <> 'accept' AND NOT waits").select(
            *_HEAD, "verdict", "batch").distinct()

    def held(self, before: int | None = None) -> DataFrame | None:
        """Entries that wait for an earlier delta, as the last batch (``before`` one) left them."""
        log = self.log()
        if log is None:
            return None
        past = log if before is None else log.where(F.col("batch") < before)
        last = past.agg(F.max("batch")).first()[0]
        return past.where(F.col("batch") == last).where("waits").drop("verdict", "waits", "batch")


def start_feed(records: DataFrame, sequences: DataFrame, path: str, batch: int = START) -> Feed:
    """Start a feed from records and ``agent_id, last_sequence`` rows, as they are after ``batch``."""
    spark = records.sparkSession
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/start")
    records.withColumn("ord", F.col("ord").cast(ORD)).write.mode("overwrite").parquet(f"{path}/base")
    sequences.select("agent_id", F.col("last_sequence").cast("bigint")).write.mode("overwrite").parquet(f"{path}/sequences")
    return Feed(spark, path)


def fold_feed(feed: Feed, path: str) -> Feed:
    """A new feed at ``path`` whose base holds what the log of ``feed`` did; what waits goes on waiting.

    Run between two runs of the stream, which goes on with the new feed and its old checkpoint.
    """
    last = feed.last_batch()
    out = start_feed(feed.records(), feed.sequences(), path, feed.start() if last is None else last)
    if last is not None:
        feed.log().where((F.col("batch") == last) & F.col("waits")).drop("batch").write.mode("overwrite").parquet(
            f"{path}/log/batch={last}")
    return out


def gate(deltas: DataFrame, sequences: DataFrame) -> DataFrame:
    """Verdict on each delta of a batch: ``accept``, or why not (X21, ST2).

    ``deltas``: ``agent_id, base_sequence, delta_seq, record_count``, one row per entry;
    the count is the one of the delta's manifest.  Without it nobody could tell a part of a
    delta from the whole, so a delta that has none is ``uncounted`` and refused.  A delta is accepted when its base is the agent's last sequence,
    or the sequence of the accepted delta before it.  ``gap`` and ``incomplete`` deltas
    may become acceptable later, ``stale`` and ``conflict`` never.
    """
    expected = F.max("record_count") if "record_count" in deltas.columns else F.lit(None)
    heads = deltas.groupBy("agent_id", "base_sequence", "delta_seq").agg(
        F.count(F.lit(1)).alias("n"), expected.cast("bigint").alias("expected")
    ).join(sequences, "agent_id", "left").withColumn(
        "last", F.coalesce("last_sequence", F.lit(0)).cast("bigint")
    )
    stale = F.col("base_sequence") < F.col("last")
    same_base = Window.partitionBy("agent_id", "base_sequence").orderBy("delta_seq")
    heads = heads.withColumn("_stale", stale).withColumn(
        "_second", F.row_number().over(same_base) > 1
    )
    running = ~F.col("_stale") & ~F.col("_second")
    chain = Window.partitionBy("agent_id", running.cast("int")).orderBy("base_sequence", "delta_seq")
    before = F.lag("delta_seq").over(chain)
    whole = F.coalesce(F.col("n") >= F.col("expected"), F.lit(False))
    heads = heads.withColumn("_next", F.col("base_sequence") == F.coalesce(before, F.col("last")))
    heads = heads.withColumn("_whole", whole)
    upto = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.bool_and(F.col("_next") & F.col("_whole")).over(upto)
    verdict = (
        F.when(F.col("_stale"), "stale")
        .when(F.col("_second"), "conflict")
        .when(F.col("expected").isNull(), "uncounted")
        .when(ok, "accept")
        .when(~F.col("_whole"), "incomplete")
        .otherwise("gap")
    )
    return heads.select(
        "agent_id", "base_sequence", "delta_seq", "last", verdict.alias("verdict")
    )


def apply_batch(feed: Feed, batch_df: DataFrame, batch: int, on_gap: str = "reject") -> None:
    """Judge one micro-batch of deltas and write it to the log (ST1).

    Batches before ``batch`` are all that counts, so a repeated batch gives the same rows.
    Spark repeats the last batch only: an older number comes from a checkpoint that is not
    this feed's and is refused, and one that the base holds after a fold does nothing.  An
    entry that comes twice (same delta, ``pos``, id and operation) counts once.
    """
    if batch <= feed.start():
        return
    last = feed.last_batch()
    if last is not None and batch < last:
        raise ValueError(f"batch {batch} comes after batch {last} of {feed.path}; the checkpoint is not this feed's")
    incoming = batch_df
    waiting = feed.held(before=batch)
    if waiting is not None:
        incoming = incoming.unionByName(waiting, allowMissingColumns=True)
    incoming = incoming.dropDuplicates([*_HEAD, "pos", "id", "operation"])
    # only agents of this batch are looked up
    sequences = feed.sequences(before=batch).join(incoming.select("agent_id").distinct(), "agent_id", "left_semi")
    verdicts = gate(incoming, sequences).select(*_HEAD, "verdict")
    waits = F.col("verdict").isin("gap", "incomplete") if on_gap == "hold" else F.lit(False)
    incoming.join(verdicts, _HEAD).withColumn("waits", waits).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(f"{feed.path}/log/batch={batch}")


def stream_apply_deltas(
    stream: DataFrame,
    feed: Feed,
    checkpoint: str,
    on_gap: str = "reject",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Apply a stream of delta entries to ``feed`` in sequence order per agent (ST1).

    ``stream``: delta entries with ``base_sequence``, ``delta_seq`` and ``record_count``.  With
    ``on_gap="reject"`` a delta whose predecessor is missing is refused; with ``"hold"``
    it waits for it (ST2).
    """
    if on_gap not in ("reject", "hold"):
        raise ValueError("on_gap must be 'reject' or 'hold'")
    return (
        stream.writeStream.foreachBatch(lambda df, n: apply_batch(feed, df, n, on_gap))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_records(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Records of a growing directory of JSON-lines files, as a stream (ST3)."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return records_of_lines(text_lines(lines))
