"""Dense list positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import by_key, cut_lineage


def with_position(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "pos", along: DataFrame | None = None
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``, ordered by ``order``.

    One key may hold most rows, so a window per key would run in one task.  The distinct
    values of key and order are counted and range-partitioned by both instead: a key spans
    as many partitions as it needs, each sums its own counts, and the sums of the earlier
    partitions of the key are added.  Rows themselves move once, to meet their position;
    rows of equal order get consecutive ones.  The ranges are drawn by sampling, so these
    narrow rows are pinned by a checkpoint before they are used twice.

    ``along``: columns for each key (one row a key, null where it has none) that the rows
    get with their position, so they do not move again for them.
    """
    by = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [c.alias(f"_o{i}") for i, c in enumerate(order)]
    groups = [f"_k{i}" for i in range(len(keys))]
    names = groups + [f"_o{i}" for i in range(len(order))]
    counted = df.select(*by).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut_lineage(counted.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*groups, "_range").agg(F.sum("_n").alias("_all"))
    offsets = totals.select(
        *[F.col(g).alias(f"_t{g}") for g in groups], F.col("_range").alias("_r"),
        F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_offset"))
    more = []
    if along is not None:
        more = [c for c in along.columns if c not in keys]
        carried = along.select(*[F.col(k).alias(f"_t{g}") for k, g in zip(keys, groups)], *more)
        offsets = offsets.join(by_key(carried), [f"_t{g}" for g in groups], "left")
    within = Window.partitionBy(*groups, "_range").orderBy(*[n for n in names if n not in groups])
    summed = ranged.withColumn("_before", F.coalesce(
        F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = F.col("_range") == F.col("_r")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_t{g}"))
    placed = summed.join(by_key(offsets), on).select(
        F.struct(*names).alias("_place"), (F.col("_offset") + F.col("_before")).alias("_start"), "_n", *more)
    # a struct is never null and its null fields are equal, so join and window share one distribution
    joined = df.select("*", F.struct(*by).alias("_tag")).join(by_key(placed), F.col("_tag") == F.col("_place"))
    # equal rows: the join has brought them together
    again = Window.partitionBy("_place").orderBy(F.lit(0))
    pos = F.col("_start") + F.when(F.col("_n") > 1, F.row_number().over(again) - 1).otherwise(0)
    return joined.select(*df.columns, *more, pos.cast("bigint").alias(name))


def with_order(records: DataFrame, tie: list[Column] | None = None) -> DataFrame:
    """Add ``ord = (0, pos)``: position in the agent's list by creation time.

    Equal times are ordered by ``tie``, by default the file the record came from, its
    line there, and its id.
    """
    line = F.get_json_object("raw_source_format", "$.line_start").try_cast("bigint")
    tie = tie or [
        F.coalesce(F.col("source.origin_file"), F.lit("")), F.coalesce(line, F.lit(0)), F.col("id")
    ]
    placed = with_position(records, ["agent_id"], [F.col("temporal.created_at"), *tie], "_pos")
    return placed.withColumn(
        "ord", F.struct(F.lit(0).alias("delta"), F.col("_pos").alias("pos"))
    ).drop("_pos")
