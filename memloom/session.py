"""Session settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # archives are whole files: bound an Arrow batch by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above; cluster sizes stay as the session has them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is used only where none is named, and only in local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@functools.cache
def _own_dir(application: str) -> str:
    """A folder for one application in local mode, gone when Python ends."""
    path = tempfile.mkdtemp(prefix="memloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts both sides by key.

    Before a job runs, sizes are guessed from files, and small files of short columns may
    hold millions of agents or records; a broadcast of those goes through the driver.  For
    tables that grow with the fleet; others are left to AQE, which measures.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame, eager: bool = False) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, a folder all executors share, and read back.

    For records that are used more than once: columns on disk are smaller than shuffled rows
    or a checkpoint of them, and what comes before is not computed anew.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
