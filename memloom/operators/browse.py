"""A browser of memory: postings of records by facet, kept current by deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.delta import KEY
from memloom.schemas import DELTA_OPERATIONS
from memloom.sources.sinks import BUCKETS, exists, remove, replace_dir, with_bucket

#: What a record can be found by.  ``day`` and ``all`` serve date ranges and plain lists.
FACETS = ("all", "type", "status", "tag", "entity", "day")
POSTING_COLUMNS = ["agent_id", "id", "value", "seen", "facet", "bucket"]
POSTING = "agent_id string, id string, value string, seen timestamp, facet string, bucket int"


def postings(records: DataFrame) -> DataFrame:
    """``facet``, ``value``, ``agent_id``, ``id`` and ``seen``: a row for each value a record has of a facet."""
    seen = F.coalesce(F.col("temporal.observed_at"), F.col("temporal.created_at"))
    one = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
    many = lambda facet, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: one(facet, x))
    entries = F.array_distinct(F.concat(
        F.array(one("all", F.lit("")), one("type", F.col("memory_type")), one("status", F.col("status")), one("day", F.to_date(seen))),
        many("tag", F.col("tags")), many("entity", F.col("entities")["name"])))
    rows = records.select(*KEY, seen.alias("seen"), F.explode(entries).alias("e"))
    return rows.select(*KEY, "seen", "e.*").where("value IS NOT NULL")


def _write(rows: DataFrame, path: str) -> None:
    out = rows.hint("rebalance", "bucket", "facet").sortWithinPartitions("bucket", "facet", "agent_id", "value", "seen")
    out.select(*POSTING_COLUMNS).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy("bucket", "facet").parquet(path)


def write_index(records: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the postings of ``records``, by agent bucket and facet and sorted by agent and value."""
    _write(with_bucket(postings(records), buckets), path)


def upsert_index(spark: SparkSession, path: str, deltas: DataFrame, buckets: int = BUCKETS) -> None:
    """Bring the index at ``path`` forward by ``deltas`` (operation, position and record).

    The last entry of an id decides.  Only buckets of agents in ``deltas`` are written anew,
    of at most ``buckets``; running it again changes nothing more.  New postings are written
    aside first, as they come from those they replace.
    """
    place = F.struct("delta_seq", "pos").alias("place")
    body = [c for c in deltas.columns if c not in KEY]
    last = deltas.where(F.col("operation").isin(*DELTA_OPERATIONS)).select(*KEY, place, F.struct(*body).alias("d"))
    last = last.groupBy(*KEY).agg(F.max_by("d", "place").alias("d")).select(*KEY, "d.*")
    here = [r[0] for r in with_bucket(last.select(*KEY), buckets).select("bucket").distinct().collect()]
    kept = read_index(spark, path).where(F.col("bucket").isin(here)).join(last.select(*KEY), KEY, "left_anti")
    fresh = with_bucket(postings(last.where("operation <> 'delete'")), buckets)
    aside = f"{path}-next"
    _write(kept.select(*POSTING_COLUMNS).unionByName(fresh.select(*POSTING_COLUMNS)), aside)
    staged = read_index(spark, aside)
    whole = {(r[0], r[1]) for r in staged.select("bucket", "facet").distinct().collect()}
    # written whole and in order, so directories take the place of the old ones without a second shuffle
    for bucket, facet in sorted(whole):
        replace_dir(spark, f"{aside}/bucket={bucket}/facet={facet}", f"{path}/bucket={bucket}/facet={facet}")
    for bucket in here:  # facets that no record has any more
        for facet in FACETS:
            if (bucket, facet) not in whole and exists(spark, f"{path}/bucket={bucket}/facet={facet}"):
                remove(spark, f"{path}/bucket={bucket}/facet={facet}")
    remove(spark, aside)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(path)


def browse(
    spark: SparkSession,
    path: str,
    agents: list[str] | None = None,
    buckets: int = BUCKETS,
    days: tuple[str, str] | None = None,
    **facets: str | list[str],
) -> DataFrame:
    """``agent_id``, ``id`` and ``seen`` of the records that have all of ``facets``, any of the values given for one.

    ``browse(spark, path, ["a"], status="active", tag=["x", "y"], days=("2026-01-01", "2026-02-01"))``:
    days count from the first to before the second.  Only directories of the facets asked for,
    and of the buckets of ``agents``, are read, and values go to the scan.
    """
    unknown = set(facets) - set(FACETS)
    if unknown:
        raise ValueError(f"unknown facets {sorted(unknown)}; there are {list(FACETS)}")
    index = read_index(spark, path)
    if agents is not None:
        names = spark.createDataFrame([(a,) for a in agents], "agent_id string")
        here = [r[0] for r in with_bucket(names, buckets).select("bucket").distinct().collect()]
        index = index.where(F.col("bucket").isin(here) & F.col("agent_id").isin(agents))
    sets = []
    for facet, values in facets.items():
        values = [values] if isinstance(values, str) else list(values)
        rows = index.where((F.col("facet") == facet) & F.col("value").isin(values))
        sets.append(rows.select(*KEY, "seen").distinct() if len(values) > 1 else rows.select(*KEY, "seen"))
    if days is not None:
        sets.append(index.where((F.col("facet") == "day") & (F.col("value") >= days[0]) & (F.col("value") < days[1])).select(*KEY, "seen"))
    if not sets:
        sets.append(index.where("facet = 'all'").select(*KEY, "seen"))
    return reduce(lambda a, b: a.join(b.select(*KEY), KEY, "left_semi"), sets)


def page(found: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The ``size`` latest records after the (``seen``, ``agent_id``, ``id``) a page before ended with; a bounded top-k, no full sort."""
    if after is not None:
        seen, agent, key = (F.lit(x) for x in after)
        same = F.col("seen") == seen
        found = found.where((F.col("seen") < seen) | same & ((F.col("agent_id") > agent) | (F.col("agent_id") == agent) & (F.col("id") > key)))
    return found.where("seen IS NOT NULL").orderBy(F.desc("seen"), "agent_id", "id").limit(size)


def facet_counts(index: DataFrame, *facets: str) -> DataFrame:
    """Records per ``facet`` and ``value``, as a browser lists them."""
    rows = index.where(F.col("facet").isin(*facets)) if facets else index
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))
