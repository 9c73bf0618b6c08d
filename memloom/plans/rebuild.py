"""A base snapshot and a chain of deltas to a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import snapshot as snap
from memloom.operators.delta import KEY, apply_deltas
from memloom.schemas import CREDENTIAL_DDL, DELTA_OPERATIONS, IDENTITY_DDL, PRINCIPAL_DDL, struct_type
from memloom.session import by_key
from memloom.sources import archives, sinks
from memloom.sources.sinks import BUCKETS, Snapshot

#: Tables of a snapshot that a delta replaces as a whole.
LAYERS = ("identities", "principals", "credentials", "layer_docs")


def _pick(spark: SparkSession, path: str, kind: str, staged: DataFrame | None):
    if staged is not None:
        return lambda *roles: staged.where(F.col("role").isin(*roles))
    return lambda *roles: archives.scan_archives(spark, path, kind, roles)


def read_snapshot(spark: SparkSession, path: str, staged: DataFrame | None = None) -> Snapshot:
    """The tables of all snapshot archives under ``path``.

    ``staged``: entries of :func:`memloom.sources.archives.stage_archives`, so that the
    archives are unpacked once and not once per layer.
    """
    only = _pick(spark, path, "snapshot", staged)
    return Snapshot(
        records=archives.scan_records(only("memory")).drop("archive"),
        manifests=archives.manifests(only("manifest")),
        attachments=archives.scan_layer(only("attachments"), "attachments"),
        files=only("file").select("archive", "agent_id", "entry", "data"),
        layer_docs=archives.scan_layer_documents(only("identity", "principals", "credentials")),
    )


def read_deltas(
    spark: SparkSession, path: str, staged: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, manifests and layer documents of all delta archives under ``path``."""
    only = _pick(spark, path, "delta", staged)
    marks = archives.delta_manifests(only("manifest"))
    entries = archives.scan_deltas(only("memory")).drop("archive")
    docs = archives.scan_layer_documents(only("identity", "principals", "credentials"))
    return entries, marks, docs


def layer_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of the replaceable layers out of their documents."""
    of = lambda layer: docs.where(F.col("layer") == layer)

    def items(layer: str, ddl: str) -> DataFrame:
        typ = struct_type(ddl).simpleString()
        parsed = F.from_json("doc", f"struct<{layer}:array<{typ}>>")[layer]
        rows = of(layer).select(F.col("agent_id").alias("owner"), F.posexplode(parsed).alias("pos", "d"))
        return rows.select("owner", "pos", "d.*")

    identity = of("identity").select(
        F.col("agent_id").alias("owner"), F.from_json("doc", IDENTITY_DDL).alias("d")
    )
    return {
        "identities": identity.select("owner", "d.*"),
        "principals": items("principals", PRINCIPAL_DDL),
        "credentials": items("credentials", CREDENTIAL_DDL),
    }


def rebuild_snapshot(
    base: Snapshot,
    deltas: DataFrame | None,
    delta_marks: DataFrame | None,
    as_of: Column,
    delta_docs: DataFrame | None = None,
) -> Snapshot:
    """Fold deltas into a base snapshot.

    Records are folded and put into their quarters again, sealed where the quarter is
    over; each layer is the last one given; raw and artifact files are carried over;
    attachments stay as they are.  Without deltas the base is only put in order.
    """
    records = base.records if deltas is None else apply_deltas(base.records, deltas)
    files = None if base.files is None else snap.carry_files(base.files)
    memory = snap.memory_inventory(records, as_of, seal="elapsed", raw_agents=_raw(files))
    return _put_together(base, records, files, memory, delta_marks, as_of, delta_docs)


def _raw(files: DataFrame | None) -> DataFrame | None:
    return None if files is None else files.where(F.col("entry").startswith("raw/"))


def _put_together(
    base: Snapshot,
    records: DataFrame,
    files: DataFrame | None,
    memory: DataFrame,
    delta_marks: DataFrame | None,
    as_of: Column,
    delta_docs: DataFrame | None,
) -> Snapshot:
    """The new snapshot from its records and their inventory."""
    docs = base.layer_docs
    if docs is not None and delta_docs is not None:
        docs = docs.unionByName(delta_docs)
    tables: dict[str, DataFrame | None] = {
        "identities": base.identities, "principals": base.principals, "credentials": base.credentials,
    }
    if docs is not None:
        docs = snap.latest_layers(docs)
        tables = layer_tables(docs)

    start = base.manifests.select("agent_id", F.col("sync.last_sequence").alias("last_sequence"))
    none = start.limit(0).select("agent_id", F.lit(0).alias("base_sequence"), F.lit(0).alias("new_sequence"))
    marks = none if delta_marks is None else delta_marks.select(
        "agent_id", F.col("sync.base_sequence").alias("base_sequence"),
        F.col("sync.new_sequence").alias("new_sequence"),
    )
    sequences = snap.highest_sequence(start, marks)

    identities = tables["identities"]
    keyed = identities
    if identities is not None and "owner" in identities.columns:
        keyed = identities.drop("agent_id").withColumnRenamed("owner", "agent_id")
    credentials = tables["credentials"]
    if credentials is not None and "owner" in credentials.columns:
        credentials = credentials.drop("agent_id").withColumnRenamed("owner", "agent_id")
    layers = snap.layer_inventory(
        base.manifests, keyed, tables["principals"], credentials, memory, base.attachments
    )
    agents = base.manifests.drop("archive", "layers", "sync", "created_at", "checksum")
    return Snapshot(
        records=records,
        manifests=snap.build_manifest(agents, layers, as_of, sequences),
        identities=identities, principals=tables["principals"], credentials=tables["credentials"],
        attachments=base.attachments, files=files, layer_docs=docs,
    )


def touched_parts(records: DataFrame, deltas: DataFrame, buckets: int = BUCKETS) -> list[str]:
    """Directories of written ``records`` that ``deltas`` change, as ``quarter/bucket``.

    A record leaves the quarters where its id stands now and enters the one of its new
    times.  Ids are looked up in the buckets of their agents only, by two columns.  There
    are at most ``buckets`` directories for each quarter, so the list is short.
    """
    entries = deltas.where(F.col("operation").isin(*DELTA_OPERATIONS))
    keys = entries.select(*KEY).distinct()
    left = sinks.in_reach(records, keys, buckets).select(*KEY, "quarter", "bucket")
    left = left.join(keys, KEY, "left_semi").select(sinks.part())
    entered = sinks.with_bucket(sinks.with_quarter(entries.where("operation <> 'delete'")), buckets).select(sinks.part())
    return sorted(r[0] for r in left.union(entered).distinct().collect())


def update_snapshot(
    spark: SparkSession,
    path: str,
    deltas: DataFrame,
    delta_marks: DataFrame | None,
    as_of: Column,
    delta_docs: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> Snapshot:
    """Fold deltas into the snapshot that :func:`write_snapshot` wrote at ``path``, in place.

    Only the quarters of an agent bucket that a record leaves or enters are read, folded and
    written; all other record files stay as they are, and their counts are carried over from
    the old manifests.  The new directories, layers and manifests are first written aside,
    under ``touched``; a job that dies after that goes on from there when it is run again.
    As with :func:`rebuild_snapshot`, agents without a manifest get none.
    """
    aside = f"{path}/touched"
    if not sinks.exists(spark, f"{aside}/parts/_SUCCESS"):
        sinks.remove(spark, aside)
        base = sinks.read_snapshot_tables(spark, path)
        stored = spark.read.parquet(f"{path}/records")
        parts = touched_parts(stored, deltas, buckets)
        inside = stored.where(sinks.part().isin(parts)).drop("quarter", "bucket")
        sinks.write_records(apply_deltas(inside, deltas), f"{aside}/records", buckets=buckets)
        # without a record left there is no file to tell the columns
        folded = spark.read.schema(stored.schema).parquet(f"{aside}/records")
        memory = snap.memory_section(
            snap.quarter_counts(folded).unionByName(_carried(base.manifests, stored, parts, buckets)),
            as_of, raw_agents=_raw(base.files))
        new = _put_together(base, folded, base.files, memory, delta_marks, as_of, delta_docs)
        for name in LAYERS if delta_docs is not None else ():
            table = new.tables().get(name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{aside}/{name}")
        new.manifests.write.mode("overwrite").parquet(f"{aside}/manifests")
        spark.createDataFrame([(p,) for p in parts], "part string").coalesce(1).write.mode("overwrite").parquet(f"{aside}/parts")

    parts = {r[0] for r in spark.read.parquet(f"{aside}/parts").collect()}
    sinks.remove(spark, f"{path}/manifests")
    folded = sinks.replace_parts(spark, f"{aside}/records", f"{path}/records")
    for part in parts - folded:  # nothing is left there
        quarter, bucket = part.split("/")
        sinks.remove(spark, f"{path}/records/quarter={quarter or '__HIVE_DEFAULT_PARTITION__'}/bucket={bucket}")
    for name in (*LAYERS, "manifests"):
        if sinks.exists(spark, f"{aside}/{name}"):
            spark.read.parquet(f"{aside}/{name}").write.mode("overwrite").parquet(f"{path}/{name}")
    sinks.remove(spark, aside)
    return sinks.read_snapshot_tables(spark, path)


def _carried(manifests: DataFrame, stored: DataFrame, parts: list[str], buckets: int) -> DataFrame:
    """Rows of :func:`quarter_counts` for all quarters of an agent that stay as they are.

    A manifest has one embedding flag for all quarters of an agent.  Where a bucket changes
    in some quarter, the flags of its other quarters are read off the records again, from
    the dimensions alone.
    """
    memory = F.col("layers.memory")
    rows = sinks.with_bucket(manifests, buckets).select(
        "agent_id", "bucket", memory["has_embeddings"].alias("flag"), F.explode(memory["partitions"]).alias("p"))
    rows = rows.withColumn("quarter", F.regexp_extract("p.file", r"(\d+-Q[1-4])", 1)).where(~sinks.part().isin(parts))
    here = sorted({int(p.split("/")[1]) for p in parts})
    again = stored.where(F.col("bucket").isin(here) & ~sinks.part().isin(parts)).groupBy("agent_id").agg(
        F.bool_or(F.size(F.col("embeddings")["dimensions"]) > 0).alias("found"))
    flag = F.when(F.col("bucket").isin(here), F.coalesce("found", F.lit(False))).otherwise(F.col("flag"))
    return rows.join(by_key(again), "agent_id", "left").select(
        "agent_id", F.col("p.file").alias("file"), F.col("p.from").alias("from"), F.col("p.to").alias("to"),
        F.col("p.record_count").alias("record_count"), flag.alias("has_embeddings"))
