"""Workspaces to a snapshot, and snapshots back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import memories, migrate, profiles, snapshot as snap, workspace_settings
from memloom.operators.ordering import with_order
from memloom.plans.rebuild import layer_tables
from memloom.plans.registry import register
from memloom.schemas import IDENTITY_DDL, MANIFEST_DDL, PRINCIPAL_DDL, struct_of, struct_type
from memloom.sources import workspaces as ws
from memloom.sources.sinks import Snapshot


def openclaw_to_records(files: DataFrame, **_: object) -> DataFrame:
    return memories.openclaw_records(ws.note_files(files, "openclaw"))


def zeroclaw_to_records(
    files: DataFrame,
    as_of: Column,
    rows: DataFrame | None = None,
    config: DataFrame | None = None,
) -> DataFrame:
    """Records of each workspace's own backend."""
    config = workspace_settings.config_fields(files) if config is None else config
    routed = ws.route_backends(files, config)
    version = config.select("agent_id", "runtime_version", "embedding_provider")
    of = lambda kind: routed.where(F.col("backend") == kind).join(
        version, "agent_id", "left"
    ).drop("backend")
    notes = ws.note_files(files, "zeroclaw").join(of("markdown"), "agent_id")
    records = memories.zeroclaw_note_records(notes)
    if rows is not None:
        table = ws.memory_table(files.sparkSession, rows).drop(
            "embedding_provider", "runtime_version"
        ).join(of("table"), "agent_id")
        records = records.unionByName(memories.zeroclaw_table_records(table, as_of))
    return records


register("openclaw", openclaw_to_records,
         lambda records: migrate.rebuilt_files(records, "openclaw"), "Markdown notes")
register("zeroclaw", zeroclaw_to_records,
         lambda records: migrate.rebuilt_files(records, "zeroclaw"),
         "memory table or Markdown notes")


def export_workspaces(
    files: DataFrame, runtime: str, as_of: Column, rows: DataFrame | None = None
) -> Snapshot:
    """A snapshot of every workspace in a file table.

    ``files`` comes from :func:`memloom.sources.workspaces.scan_workspaces`; ``rows``
    are memory table rows by ``agent_id``.
    """
    places = ws.workspaces(files)
    config = credentials = None
    version: Column = F.lit(None)
    if runtime == "zeroclaw":
        config = workspace_settings.config_fields(files)
        records = zeroclaw_to_records(files, as_of, rows, config)
        hints = workspace_settings.credential_hints(files)
        credentials = workspace_settings.credential_rows(hints, as_of)
    else:
        records = openclaw_to_records(files)
    records = with_order(records)
    identities = profiles.identities(files, as_of, config)
    principals = profiles.principals(files, as_of, runtime)
    kept = ws.raw_sources(files, runtime, config)
    raw = kept.withColumn("entry", F.concat(F.lit(f"raw/{runtime}/"), "path"))

    names = profiles.agent_names(files, places, config)
    agents = names
    if config is not None:
        agents = names.join(config.select("agent_id", "runtime_version"), "agent_id", "left")
        version = F.col("runtime_version")
    agent_t = struct_type(MANIFEST_DDL)["agent"].dataType.simpleString()
    agents = agents.select(
        "agent_id",
        struct_of(
            agent_t, id=F.col("agent_id"), name=F.col("name"), source_runtime=F.lit(runtime),
            source_runtime_version=version,
        ).alias("agent"),
        F.array(F.lit(runtime)).alias("raw_sources"),
    )
    memory = snap.memory_inventory(records, as_of, seal="never", raw_agents=raw)
    layers = snap.layer_inventory(agents, identities, principals, credentials, memory)
    return Snapshot(
        records=records,
        manifests=snap.build_manifest(agents, layers, as_of),
        identities=identities, principals=principals, credentials=credentials,
        files=raw.select("agent_id", "entry", "data"),
    )


def import_files(snapshot: Snapshot, runtime: str) -> DataFrame:
    """Workspace files of a snapshot for a runtime: ``agent_id, path, part, data``.

    Agents whose snapshot carries the runtime's own files get exactly those; the others
    get files rebuilt from their layers and records, and everyone an agent-id file.
    A file is one row, with ``part`` null, unless it is rebuilt from records and too large for
    that (see :func:`migrate.rebuilt_files`).
    """
    agents = snapshot.manifests.select("agent_id")
    ids = migrate.agent_id_files(agents).select(
        "agent_id", "path", F.col("content").cast("binary").alias("data")
    )
    restored = migrate.restore_files(snapshot.files, runtime) if snapshot.files is not None else None
    rest = agents
    if restored is not None:
        rest = agents.join(restored.select("agent_id").distinct(), "agent_id", "left_anti")
    made = migrate.rebuilt_files(snapshot.records, runtime).select(
        "agent_id", "path", "part", F.col("content").cast("binary").alias("data")
    )
    identities, principals = snapshot.identities, snapshot.principals
    if snapshot.layer_docs is not None:  # a snapshot that was read has its layers as documents
        typed = layer_tables(snapshot.layer_docs)
        if identities is None:
            identities = typed["identities"].drop("agent_id").withColumnRenamed("owner", "agent_id")
        principals = typed["principals"] if principals is None else principals
    if identities is not None or principals is not None:
        spark = snapshot.records.sparkSession
        if identities is None:
            identities = spark.createDataFrame([], struct_type(IDENTITY_DDL))
        if principals is None:
            principals = spark.createDataFrame([], f"owner string, pos int, {PRINCIPAL_DDL}")
        persona = migrate.profile_files(identities, principals, runtime)
        made = made.unionByName(persona.select(
            "agent_id", "path", F.col("content").cast("binary").alias("data")
        ), allowMissingColumns=True)
    out = made.join(rest, "agent_id", "left_semi").unionByName(ids, allowMissingColumns=True)
    if restored is not None:
        out = out.unionByName(restored.select("agent_id", "path", "data"), allowMissingColumns=True)
    return out
