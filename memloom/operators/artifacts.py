"""Workspace artifacts in three tiers: always packed, packed while they fit, and only referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import cut_lineage

#: Fixed value: largest artifact that is packed by default.
SIZE_THRESHOLD = 10 * 1024 * 1024
#: Settings up to this size are packed with the raw sources.
CONFIG_BYTES = 64 * 1024
_CONFIG = r"(?i)\.(toml|json|ya?ml|ini|cfg|env)\z"


def running_total(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows of ``key`` up to and with this one, in ``order``.

    A key may hold most rows.  Rows are dealt in ranges of key and order, so such a key spans
    many ranges; each sums its own, and the totals of the key's earlier ranges are added.
    ``order`` must tell the rows of a key apart.  Nulls of ``value`` count 0.
    """
    ranged = cut_lineage(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    amount = F.coalesce(F.col(value), F.lit(0))
    totals = ranged.groupBy(key, "_range").agg(F.sum(amount).alias("_all"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_own", F.sum(amount).over(within))
    on = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))
    return summed.join(offsets, on).select(*rows.columns, (F.col("_own") + F.col("_offset")).alias(name))


def tier_artifacts(
    files: DataFrame, threshold: int = SIZE_THRESHOLD, budget: int | None = None, runtime: str = "openclaw", raw: Column | None = None
) -> DataFrame:
    """``agent_id``, ``path``, ``size_bytes``, ``tier`` and ``archive_path`` (null: only referred to) of workspace files.

    Tier 1 are raw sources (``raw``, by default Markdown files) and settings of ``CONFIG_BYTES``
    or less; tier 2 is what is no larger than ``threshold``, the smallest first, while an agent's
    total stays within ``budget``; the rest is tier 3.  Files of unknown size are tier 3; equal
    sizes go by path.  ``archive_path`` is what :func:`memloom.operators.snapshot.attachment_rollup` counts by.
    """
    path, size = F.col("path"), F.col("size_bytes")
    source = path.rlike(r"(?i)\.md\z") if raw is None else raw
    first = F.when(source | (path.rlike(_CONFIG) & (size <= CONFIG_BYTES)), 1).when(size <= threshold, 2).otherwise(3)
    rows = files.select("agent_id", "path", "size_bytes", first.alias("tier"))
    if budget is not None:
        # only what competes for the budget is ordered
        second = running_total(rows.where("tier = 2"), "agent_id", ["size_bytes", "path"], "size_bytes", "_total")
        second = second.withColumn("tier", F.when(F.col("_total") <= budget, 2).otherwise(3)).drop("_total")
        rows = rows.where("tier <> 2").unionByName(second)
    place = F.when(F.col("tier") == 1, F.concat(F.lit(f"raw/{runtime}/"), path)).when(F.col("tier") == 2, F.concat(F.lit("artifacts/"), path))
    return rows.withColumn("archive_path", place)
