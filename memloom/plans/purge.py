"""Removal of single records from a written snapshot, with an audit row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.delta import KEY
from memloom.plans.rebuild import update_snapshot
from memloom.schemas import RECORD_FIELDS
from memloom.sources import sinks
from memloom.sources.sinks import BUCKETS


def find_records(spark: SparkSession, path: str, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``agent_id``, ``id``, ``part`` and ``file`` of every stored copy of ``keys`` in the snapshot at ``path``.

    Only the directories of the keys' agent buckets are looked into.  Where the keys are few
    their ids are pushed to the scan, and the Bloom filters that ``write_records`` keeps for
    each block of a file skip those without one.  No content is read.
    """
    stored = sinks.in_reach(spark.read.parquet(f"{path}/records"), keys, buckets)
    found = stored.select(*KEY, sinks.part(), F.col("_metadata.file_path").alias("file"))
    return found.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def purge_records(
    spark: SparkSession, path: str, requests: DataFrame, as_of: Column, run: str, buckets: int = BUCKETS
) -> DataFrame:
    """Take the records of ``requests`` (``agent_id``, ``id``, ``reason``) out of the snapshot at ``path``.

    Directories that hold one are written anew without it, all others stay; manifests count
    what is left.  The audit rows of the run come back: one for each request and directory
    it was found in, and one without a directory where it was not found.  They are written
    first, under ``purges/run=``, and kept when a run that died is run again: by then some
    records may be gone already.
    """
    audit = f"{path}/purges/run={run}"
    if not sinks.exists(spark, f"{audit}/_SUCCESS"):
        wanted = requests.groupBy(*KEY).agg(F.min("reason").alias("reason"))
        hits = find_records(spark, path, wanted, buckets).groupBy(*KEY, "part").agg(F.count("*").alias("copies"))
        rows = wanted.join(hits, KEY, "left").select(
            *KEY, "reason", "part", F.coalesce("copies", F.lit(0)).alias("copies"), as_of.alias("purged_at"))
        rows.write.mode("overwrite").parquet(audit)
    rows = spark.read.parquet(audit)
    gone = rows.select(*KEY).distinct()
    deletes = gone.select(*KEY, *[F.lit(None).cast(t).alias(c) for c, t in RECORD_FIELDS.items() if c not in KEY],
                          F.lit("delete").alias("operation"), F.lit(LAST).alias("delta_seq"), F.lit(0).cast("bigint").alias("pos"))
    update_snapshot(spark, path, deletes, None, as_of, buckets=buckets)
    return rows


#: After every delta that a record can have come from.
LAST = (1 << 62)


def purge_log(spark: SparkSession, path: str) -> DataFrame:
    """All audit rows of the snapshot at ``path``, with their ``run``."""
    return spark.read.option("basePath", f"{path}/purges").parquet(f"{path}/purges/run=*")
