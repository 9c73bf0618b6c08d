"""Snapshots and deltas as datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.json_records import opened, record_json, records_of_maps
from memloom.functions.quarters import quarter_label
from memloom.schemas import ORD, RECORD_FIELDS

BUCKETS = 256
#: Record files keep a Bloom filter of their ids for each block.
BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": "100000"}


@dataclass
class Snapshot:
    """The tables of a snapshot over a fleet; absent layers are None."""

    records: DataFrame
    manifests: DataFrame | None = None
    identities: DataFrame | None = None
    principals: DataFrame | None = None
    credentials: DataFrame | None = None
    attachments: DataFrame | None = None
    files: DataFrame | None = None
    layer_docs: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None}


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``bucket``, a fixed number of groups of agents used in directory names."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("agent_id"), F.lit(buckets)).cast("int"))


def with_quarter(records: DataFrame) -> DataFrame:
    seen = F.coalesce(F.col("temporal.observed_at"), F.col("temporal.created_at"))
    return records.withColumn("quarter", quarter_label(seen))


def part() -> Column:
    """``quarter/bucket``, the directory of a record; at most ``BUCKETS`` for each quarter."""
    return F.concat_ws("/", F.coalesce("quarter", F.lit("")), F.col("bucket").cast("string")).alias("part")


#: Ids of a search that are pushed to the scan.
PUSHED_IDS = 10


def in_reach(records: DataFrame, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of written ``records`` that may have one of ``keys`` (``agent_id``, ``id``).

    There are ``buckets`` numbers at most to choose directories by; up to ``PUSHED_IDS``
    ids go to the scan, too, where the Bloom filter of a block tells that it has none.
    """
    here = [r[0] for r in with_bucket(keys.select("agent_id").distinct(), buckets).select("bucket").distinct().collect()]
    ids = [r[0] for r in keys.select("id").distinct().limit(PUSHED_IDS + 1).collect()]
    rows = records.where(F.col("bucket").isin(here))
    return rows.where(F.col("id").isin(ids)) if len(ids) <= PUSHED_IDS else rows


def write_records(records: DataFrame, path: str, layout: str = "fleet", buckets: int = BUCKETS) -> None:
    """Write records by quarter.

    ``fleet`` keeps typed Parquet columns and ``ord`` under ``quarter=/bucket=``; agents
    share buckets, so directories do not grow with the fleet.  ``jsonl`` writes JSON
    lines under ``agent_id=/quarter=`` for exchange.  The rebalance before the write
    merges small groups and splits a quarter or agent that holds most rows.
    """
    df = with_quarter(records)
    if layout == "fleet":
        out = with_bucket(df, buckets).hint("rebalance", "quarter", "bucket")
        out = out.sortWithinPartitions("quarter", "bucket", "agent_id", "ord")
        out.select("ord", *RECORD_FIELDS, "quarter", "bucket").write.mode("overwrite").options(
            partitionOverwriteMode="static", **BLOOM
        ).partitionBy("quarter", "bucket").parquet(path)
    elif layout == "jsonl":
        out = df.hint("rebalance", "agent_id", "quarter")
        out = out.sortWithinPartitions("agent_id", "quarter", "ord")
        out.select(record_json().alias("value"), "agent_id", "quarter").write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "static").partitionBy("agent_id", "quarter").text(path)
    else:
        raise ValueError("layout must be 'fleet' or 'jsonl'")


def write_snapshot(snapshot: Snapshot, path: str, layout: str = "fleet", buckets: int = BUCKETS) -> None:
    """Write every table of a snapshot; manifests go last and mark it complete.

    Manifests of an earlier snapshot at ``path`` go first, so a job that dies in between
    leaves no complete snapshot rather than a mixed one.
    """
    remove(snapshot.records.sparkSession, f"{path}/manifests")
    write_records(snapshot.records, f"{path}/records", layout, buckets)
    tables = snapshot.tables()
    for name, df in tables.items():
        if name not in ("records", "manifests"):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    if snapshot.manifests is not None:
        snapshot.manifests.write.mode("overwrite").parquet(f"{path}/manifests")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def replace_dir(spark: SparkSession, source: str, path: str) -> None:
    """Put the directory ``source`` in the place of ``path``, as Spark does when it commits a directory it overwrites."""
    system, place = _place(spark, path)
    system.delete(place, True)
    system.mkdirs(place.getParent())
    if not system.rename(_place(spark, source)[1], place):
        raise OSError(f"{source} could not take the place of {path}")


def replace_parts(spark: SparkSession, source: str, path: str) -> set[str]:
    """Put the directories of records below ``source`` in the place of those of ``path``; they are named as ``quarter/bucket``.

    Directories that ``source`` has not stay untouched.
    """
    rows = spark.read.parquet(source) if any_file(spark, source) else None
    if rows is None:
        return set()
    out = rows.hint("rebalance", "quarter", "bucket").sortWithinPartitions("quarter", "bucket", "agent_id", "ord")
    out.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **BLOOM).partitionBy("quarter", "bucket").parquet(path)
    named = rows.select(part()).distinct()
    return {r[0] for r in named.collect()}


def any_file(spark: SparkSession, path: str) -> bool:
    """Whether a written table has a directory at all."""
    system, place = _place(spark, path)
    return system.exists(place) and any(s.isDirectory() for s in system.listStatus(place))


def read_snapshot_tables(spark: SparkSession, path: str) -> Snapshot:
    """The tables that :func:`write_snapshot` wrote in the ``fleet`` layout."""
    if not exists(spark, f"{path}/manifests"):
        raise ValueError(f"no complete snapshot at {path}: it has no manifests")
    tables = {}
    for name in Snapshot.__dataclass_fields__:
        if exists(spark, f"{path}/{name}"):
            tables[name] = spark.read.parquet(f"{path}/{name}")
    tables["records"] = tables["records"].drop("quarter", "bucket")
    return Snapshot(**tables)


def read_delta_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries and manifests of all pushes that :func:`write_deltas` wrote below ``path``.

    Entries have ``delta_seq``, ``pos``, ``operation`` and the columns of the record.  A
    push without manifests was not finished and is left out.  Entries stay in their tasks:
    the names of finished pushes are sent to them, one for each folder that was listed.
    """
    push = F.regexp_extract(F.col("_metadata.file_path"), r"/push=([^/]*)/(?:entries|manifests)/", 1)
    marks = spark.read.parquet(f"{path}/push=*/manifests").withColumn("push", push)
    lines = spark.read.parquet(f"{path}/push=*/entries").withColumn("push", push)
    lines = lines.join(F.broadcast(marks.select("push").distinct()), "push", "left_semi")
    keep = ["delta_seq", "pos", "operation"]
    maps = lines.select("delta_seq", "pos", opened(F.col("value")).alias("_m"))
    operation = F.try_variant_get(F.try_element_at("_m", F.lit("operation")), "$", "string")
    body = F.map_filter("_m", lambda k, _: k != "operation")
    rows = maps.select("delta_seq", "pos", operation.alias("operation"), body.alias("_b"))
    return records_of_maps(rows, "_b", keep), marks.drop("push")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ``fleet`` layout; filters on quarter and bucket prune directories."""
    return spark.read.parquet(path)


def delta_lines(deltas: DataFrame) -> DataFrame:
    """``value``: JSON lines of operation and record."""
    fields = ",".join(f"'{c}', {c}" for c in RECORD_FIELDS)
    line = record_json(F.expr(f"named_struct({fields})"))
    # the record's object is opened again to take the operation in
    op = F.to_json(F.struct("operation"))
    head = F.substr(op, F.lit(1), F.length(op) - 1)
    return deltas.withColumn("value", F.concat(head, F.lit(","), F.substr(line, F.lit(2))))


def write_deltas(
    deltas: DataFrame, delta_manifests: DataFrame, path: str, push: str, buckets: int = BUCKETS
) -> None:
    """Write the deltas of one push (S7): entries first, manifests last.

    A push that is run again replaces itself and nothing else.
    """
    place = F.struct(F.col("delta_seq").cast("bigint").alias("delta"), F.col("pos").alias("pos")).cast(ORD)
    rows = with_bucket(delta_lines(deltas), buckets).withColumn("_place", place)
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "agent_id", "_place")
    rows.select("agent_id", "delta_seq", "pos", "value", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("bucket").parquet(f"{path}/push={push}/entries")
    delta_manifests.write.mode("overwrite").parquet(f"{path}/push={push}/manifests")
