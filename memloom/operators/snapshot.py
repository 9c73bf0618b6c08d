"""Parts of a snapshot: layers, partitions, inventories, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.checks import rfc3339_text
from memloom.functions.quarters import partition_path, quarter_info, quarter_start
from memloom.schemas import (
    DELTA_ENTRIES_FILE, DELTA_MANIFEST_DDL, FORMAT_VERSION, MANIFEST_DDL, MEMORY_INDEX_FILE,
    PARTITION_INFO, struct_of, struct_type,
)
from memloom.session import by_key


def _type_of(ddl: str, *path: str) -> str:
    t = struct_type(ddl)
    for name in path:
        t = t[name].dataType
    return t.simpleString()


def latest_layers(layers: DataFrame) -> DataFrame:
    """Per agent and layer, the document of the last snapshot or delta that has one.

    ``layers``: ``agent_id, layer, seq, doc``; the base snapshot has ``seq`` 0.
    """
    given = layers.where(F.col("doc").isNotNull())
    return given.groupBy("agent_id", "layer").agg(
        F.max_by("doc", "seq").alias("doc"), F.max("seq").alias("seq")
    )


def highest_sequence(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Highest sequence seen per agent.

    ``base``: ``agent_id, last_sequence``; ``deltas``: ``agent_id, base_sequence,
    new_sequence``.  A delta counts with its own number and with its base plus one.
    """
    seen = base.select("agent_id", F.coalesce("last_sequence", F.lit(0)).alias("s")).unionByName(
        deltas.select(
            "agent_id",
            F.greatest(
                F.coalesce("new_sequence", F.lit(0)), F.coalesce("base_sequence", F.lit(0)) + 1
            ).alias("s"),
        )
    )
    return seen.groupBy("agent_id").agg(F.max("s").cast("bigint").alias("last_sequence"))


def with_partition(records: DataFrame) -> DataFrame:
    """Add ``partition``, the quarter file of each record."""
    return records.withColumn(
        "partition", partition_path(F.col("temporal.observed_at"), F.col("temporal.created_at"))
    )


def repartition_records(records: DataFrame) -> DataFrame:
    """Records brought together by agent and quarter, ready to write.

    A rebalance, not a plain hash repartition: small quarters are merged into one task
    and a quarter that holds most rows is split over many.
    """
    return with_partition(records).hint("rebalance", "agent_id", "partition")


def _quarter(records: DataFrame) -> Column:
    seen = F.coalesce(F.col("temporal.observed_at"), F.col("temporal.created_at"))
    return quarter_start(seen).alias("_start")


def _sealed(seal: str, as_of: Column) -> Column:
    if seal not in ("elapsed", "never"):
        raise ValueError("seal must be 'elapsed' or 'never'")
    return F.lit(False) if seal == "never" else F.col("to") < as_of.cast("date")


def partition_inventory(records: DataFrame, as_of: Column, seal: str = "elapsed") -> DataFrame:
    """Partition file, date range, record count and seal per agent and quarter.

    ``seal="elapsed"`` seals quarters that ended before ``as_of``, ``"never"`` none.
    """
    counts = records.groupBy("agent_id", _quarter(records)).agg(F.count(F.lit(1)).alias("record_count"))
    named = counts.select("agent_id", *quarter_info(F.col("_start")), "record_count")
    return named.withColumn("sealed", _sealed(seal, as_of))


def quarter_counts(records: DataFrame) -> DataFrame:
    """Partition file and range, record count and whether any has embeddings, per agent and quarter."""
    return records.groupBy("agent_id", _quarter(records)).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.bool_or(F.coalesce(F.size("embeddings") > 0, F.lit(False))).alias("has_embeddings"),
    ).select("agent_id", *quarter_info(F.col("_start")), "record_count", "has_embeddings")


def memory_inventory(
    records: DataFrame, as_of: Column, seal: str = "elapsed", raw_agents: DataFrame | None = None
) -> DataFrame:
    """Memory section of the manifest, one row per agent that has records.

    Records are counted per quarter first, so what is gathered per agent is one row per
    quarter.  ``raw_agents``: the agents (``agent_id``) with raw source files.
    """
    return memory_section(quarter_counts(records), as_of, seal, raw_agents)


def memory_section(
    per_quarter: DataFrame, as_of: Column, seal: str = "elapsed", raw_agents: DataFrame | None = None
) -> DataFrame:
    """:func:`memory_inventory` from rows of :func:`quarter_counts`."""
    info = F.struct("file", "from", "to", "record_count", _sealed(seal, as_of).alias("sealed"))
    per_agent = per_quarter.groupBy("agent_id").agg(
        F.sum("record_count").alias("record_count"),
        F.array_sort(F.collect_list(info.cast(PARTITION_INFO))).alias("partitions"),
        F.bool_or("has_embeddings").alias("has_embeddings"),
    )
    if raw_agents is None:
        has_raw = F.lit(False)
    else:
        flags = raw_agents.select("agent_id").distinct().withColumn("_raw", F.lit(True))
        per_agent = per_agent.join(by_key(flags), "agent_id", "left")
        has_raw = F.coalesce("_raw", F.lit(False))
    memory = struct_of(
        _type_of(MANIFEST_DDL, "layers", "memory"),
        record_count=F.col("record_count"), index_file=F.lit(MEMORY_INDEX_FILE),
        partitions=F.col("partitions"), has_embeddings=F.col("has_embeddings"),
        has_raw_source=has_raw,
    )
    return per_agent.select("agent_id", memory.alias("memory"))


def attachment_rollup(attachments: DataFrame) -> DataFrame:
    """Attachment section of the manifest: included and referenced counts and bytes."""
    inside = F.col("archive_path").isNotNull()
    return attachments.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(inside).alias("included_count"),
        F.coalesce(F.sum(F.when(inside, F.col("size_bytes"))), F.lit(0)).alias("included_size_bytes"),
        F.count_if(~inside).alias("referenced_count"),
        F.coalesce(F.sum(F.when(~inside, F.col("size_bytes"))), F.lit(0))
        .alias("referenced_size_bytes"),
    )


def _counted(df: DataFrame | None, key: str, name: str, file: str) -> DataFrame | None:
    if df is None:
        return None
    typ = _type_of(MANIFEST_DDL, "layers", name)
    counts = df.groupBy(F.col(key).alias("agent_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "agent_id", struct_of(typ, count=F.col("n"), file=F.lit(file)).alias(name)
    )


def layer_inventory(
    agents: DataFrame,
    identities: DataFrame | None = None,
    principals: DataFrame | None = None,
    credentials: DataFrame | None = None,
    memory: DataFrame | None = None,
    attachments: DataFrame | None = None,
) -> DataFrame:
    """``agent_id, layers``: what each agent's snapshot holds (X11).

    ``principals`` are keyed by ``owner``, everything else by ``agent_id``; ``memory``
    comes from :func:`memory_inventory`.  Missing layers stay null.
    """
    layers_t = _type_of(MANIFEST_DDL, "layers")
    parts: dict[str, DataFrame | None] = {
        "principals": _counted(principals, "owner", "principals", "principals.json"),
        "credentials": _counted(credentials, "agent_id", "credentials", "credentials.json"),
        "memory": memory,
    }
    if identities is not None:
        info = struct_of(
            _type_of(MANIFEST_DDL, "layers", "identity"), version=F.col("version"),
            file=F.lit("identity.json"),
        )
        parts["identity"] = identities.select("agent_id", info.alias("identity"))
    if attachments is not None:
        rolled = attachment_rollup(attachments)
        typ = _type_of(MANIFEST_DDL, "layers", "attachments")
        fields = {c: F.col(c) for c in rolled.columns if c != "agent_id"}
        parts["attachments"] = rolled.select(
            "agent_id", struct_of(typ, file=F.lit("attachments.json"), **fields).alias("attachments")
        )
    out = agents.select("agent_id").distinct()
    values = {}
    for name, part in parts.items():
        if part is not None:
            out = out.join(by_key(part), "agent_id", "left")
            values[name] = F.col(name)
    return out.select("agent_id", struct_of(layers_t, **values).alias("layers"))


def build_manifest(
    agents: DataFrame, layers: DataFrame, as_of: Column, sequences: DataFrame | None = None
) -> DataFrame:
    """One manifest row per agent.

    ``agents`` carries ``agent_id`` and what a manifest keeps from its base: ``agent``,
    and optionally ``alf_version``, ``runtime_hints``, ``raw_sources``, ``extra``.  The
    creation time is ``as_of``, the checksum is cleared.  ``sequences`` (X7) sets the
    sync cursor.
    """
    df = agents.join(by_key(layers), "agent_id", "left")
    if sequences is not None:
        df = df.join(by_key(sequences), "agent_id", "left")
    have = set(df.columns)
    at = rfc3339_text(as_of)
    sync_t = _type_of(MANIFEST_DDL, "sync")
    values = {
        "alf_version": F.col("alf_version") if "alf_version" in have else F.lit(FORMAT_VERSION),
        "created_at": at,
        "agent": F.col("agent"),
        "layers": F.col("layers"),
        "sync": (
            struct_of(sync_t, last_sequence=F.coalesce("last_sequence", F.lit(0)), last_sync_at=at)
            if sequences is not None else F.lit(None)
        ),
        "checksum": F.lit(None),
    }
    for name in ("runtime_hints", "raw_sources"):
        values[name] = F.col(name) if name in have else F.lit(None)
    cols = [
        values[f.name].cast(f.dataType).alias(f.name) for f in struct_type(MANIFEST_DDL).fields
    ]
    extra = (F.col("extra") if "extra" in have else F.lit(None)).cast("string").alias("extra")
    return df.select("agent_id", *cols, extra)


def carry_files(entries: DataFrame) -> DataFrame:
    """Raw and artifact files a rebuilt snapshot keeps.

    A raw entry needs a runtime folder and a name below it.
    """
    name = F.col("entry")
    raw = name.rlike(r"\Araw/[^/]*/") & ~name.endswith("/")
    artifact = name.startswith("artifacts/") & ~name.endswith("/")
    return entries.where(raw | artifact)


def delta_manifest(
    deltas: DataFrame,
    state: DataFrame,
    as_of: Column,
    runtime: Column,
    layers: DataFrame | None = None,
) -> DataFrame:
    """Manifest row of the delta each agent is about to push.

    The base is the last synced sequence; the new sequence is 0 until it is assigned.
    ``layers``: ``agent_id, layer, new_version, changed_ids`` of changed layers.
    """
    counts = deltas.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))
    df = counts if layers is None else counts.join(
        layers.select("agent_id").distinct(), "agent_id", "full_outer"
    )
    df = df.join(by_key(state), "agent_id", "left")
    part = lambda *p: _type_of(DELTA_MANIFEST_DDL, *p)
    changes = {
        "memory": F.when(F.col("n").isNotNull(), struct_of(
            part("changes", "memory"), file=F.lit(DELTA_ENTRIES_FILE), record_count=F.col("n")
        ))
    }
    if layers is not None:
        one = lambda layer, c: F.max(F.when(F.col("layer") == layer, F.col(c)))
        has = lambda layer: F.bool_or(F.col("layer") == layer)
        flags = layers.groupBy("agent_id").agg(
            has("identity").alias("_i"), one("identity", "new_version").alias("_v"),
            has("principals").alias("_p"), one("principals", "changed_ids").alias("_ids"),
            has("credentials").alias("_c"),
        )
        df = df.join(by_key(flags), "agent_id", "left")
        changes["identity"] = F.when(F.col("_i"), struct_of(
            part("changes", "identity"), file=F.lit("identity.json"), new_version=F.col("_v")))
        changes["principals"] = F.when(F.col("_p"), struct_of(
            part("changes", "principals"), file=F.lit("principals.json"), changed_ids=F.col("_ids")))
        changes["credentials"] = F.when(F.col("_c"), struct_of(
            part("changes", "credentials"), file=F.lit("credentials.json")))
    base_time = rfc3339_text(F.col("last_synced_at"))
    return df.select(
        "agent_id",
        F.lit(FORMAT_VERSION).alias("alf_version"),
        rfc3339_text(as_of).alias("created_at"),
        struct_of(part("agent"), id=F.col("agent_id"), source_runtime=runtime).alias("agent"),
        struct_of(
            part("sync"), base_sequence=F.coalesce("last_synced_sequence", F.lit(0)),
            new_sequence=F.lit(0), base_timestamp=base_time,
        ).alias("sync"),
        struct_of(part("changes"), **changes).alias("changes"),
    )
