"""Workspaces of agents as tables of files (S8, S9, S11, S12) and memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ids import agent_id, is_uuid
from memloom.functions.settings import redact
from memloom.functions.text import trim
from memloom.schemas import AGENT_ID_FILE, MEMORY_ROW_DDL, ROOT_FILES, struct_type
from memloom.sources.files import list_files, with_content


def scan_workspaces(
    spark: SparkSession, root: str, runtime: str = "openclaw", notes_only: bool = False
) -> DataFrame:
    """Files of every workspace under ``root``.

    ``workspace, agent_id, path, mtime, data, content``.  For one runtime each directory
    below ``root`` is a workspace; for the other it is a home with a ``workspace``
    directory, and its settings and database files count as files of the workspace.
    ``notes_only`` reads Markdown only.  Files are listed first, whatever their names, ids are
    attached to the listing, and each content is read once.
    """
    base = root.rstrip("/")
    prefix = base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")
    below = F.regexp_replace("path", r"\A[^/]+/", "")
    found = list_files(spark, base).where(F.col("path").contains("/")).select(
        F.substring_index("path", "/", 1).alias("_home"), below.alias("_below"), "uri", "mtime")
    if notes_only:
        found = found.where(F.col("_below").endswith(".md"))
    tail = ""
    if runtime == "zeroclaw":
        inside = F.col("_below").startswith("workspace/")
        outside = F.col("_below").isin("config.toml", "memory.db")
        path = F.when(inside, F.regexp_replace("_below", r"\Aworkspace/", "")).otherwise(F.col("_below"))
        # settings beside the workspace win over a copy inside it
        found = found.where(inside | outside).where(~(inside & (path == "config.toml")))
        tail = "/workspace"
    else:
        path = F.col("_below")
    found = found.select(
        F.concat(F.lit(f"{prefix}/"), F.col("_home"), F.lit(tail)).alias("workspace"),
        F.regexp_replace(path, r"\\", "/").alias("path"), "uri", "mtime")
    if not notes_only:
        # ids are a file each; they are read first, so contents never move for them
        ids = with_content(found.where(F.col("path") == AGENT_ID_FILE).select("workspace", "uri"))
        stored = ids.groupBy("workspace").agg(F.max(F.col("data").cast("string")).alias("_stored"))
        found = found.join(stored, "workspace", "left").withColumn(
            "agent_id", agent_id(F.col("_stored"), F.col("workspace"), runtime)).drop("_stored")
    text = F.col("path").rlike(r"\.(md|toml|json)\z") | (F.col("path") == AGENT_ID_FILE)
    return with_content(found.repartition("uri")).drop("uri").withColumn(
        "content", F.when(text, F.col("data").cast("string")))


def stage_workspaces(spark: SparkSession, root: str, runtime: str, staging: str) -> DataFrame:
    """Read every workspace once into a columnar table and return that table.

    A raw file source reads whole files for any filter on their path.  The staged table
    is sorted by path, so readers of a few named files skip the rest, and readers of
    text never touch the raw bytes.
    """
    files = scan_workspaces(spark, root, runtime)
    files.hint("rebalance").sortWithinPartitions("path").write.mode("overwrite").parquet(staging)
    return spark.read.parquet(staging)


def with_agent_ids(files: DataFrame, runtime: str) -> DataFrame:
    """Add ``agent_id``: the workspace's stored id, else one derived from its path."""
    stored = files.where(F.col("path") == AGENT_ID_FILE).groupBy("workspace").agg(
        F.max("content").alias("_stored")
    )
    return files.join(stored, "workspace", "left").withColumn(
        "agent_id", agent_id(F.col("_stored"), F.col("workspace"), runtime)
    ).drop("_stored")


def broken_agent_ids(files: DataFrame) -> DataFrame:
    """Findings for stored agent ids that are no UUIDs; such a workspace gets a derived id."""
    stored = trim(F.col("content"))
    return files.where((F.col("path") == AGENT_ID_FILE) & ~F.coalesce(is_uuid(stored), F.lit(False))).select(
        "workspace", F.lit("error").alias("severity"), F.lit("D8").alias("rule"), "path",
        F.concat(F.lit("no UUID: "), F.coalesce(stored, F.lit(""))).alias("message"))


def workspaces(files: DataFrame) -> DataFrame:
    """``agent_id, workspace`` pairs of a file table."""
    return files.select("agent_id", "workspace").distinct()


def note_files(files: DataFrame, runtime: str) -> DataFrame:
    """The files records are made of: notes under ``memory/``, for one runtime also ``MEMORY.md``."""
    path = F.col("path")
    notes = path.startswith("memory/") & path.rlike(r"[^/]\.md\z")
    if runtime == "openclaw":
        notes = notes | (path == "MEMORY.md")
    return files.where(notes)


def memory_table(spark: SparkSession, rows: DataFrame | None) -> DataFrame:
    """Rows of a memory table in the expected columns; a missing table is empty.

    Any Spark source will do.  Sort by ``timestamp`` for the source order.
    """
    schema = struct_type(MEMORY_ROW_DDL)
    if rows is None:
        return spark.createDataFrame([], schema)
    extra = [c for c in ("embedding_provider", "runtime_version") if c in rows.columns]
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ], *extra)


def raw_sources(files: DataFrame, runtime: str, config: DataFrame | None = None) -> DataFrame:
    """Files kept verbatim in a snapshot (S11): ``agent_id, path, data``.

    Fixed root files and everything under ``memory/``.  One runtime adds its settings,
    redacted, and its persona file under a fixed name.
    """
    path = F.col("path")
    plain = files.where(path.isin(*ROOT_FILES[runtime]) | path.startswith("memory/")).select(
        "agent_id", "path", "data"
    )
    if runtime != "zeroclaw":
        return plain
    settings = files.where(path == "config.toml").select(
        "agent_id", "path", redact(F.col("content")).cast("binary").alias("data")
    )
    out = plain.unionByName(settings)
    if config is not None:
        named = config.where(F.col("aieos_path").isNotNull()).select(
            "agent_id", F.col("aieos_path").alias("path")
        )
        persona = files.join(named, ["agent_id", "path"]).select(
            "agent_id", F.lit("identity.json").alias("path"), "data"
        )
        out = out.unionByName(persona)
    return out


def route_backends(files: DataFrame, config: DataFrame) -> DataFrame:
    """Where each workspace keeps its memories: ``table``, ``markdown`` or ``none``.

    A configured table without a database falls back to notes; without settings the
    database, then the notes decide.
    """
    flags = files.groupBy("agent_id").agg(
        F.bool_or(F.col("path") == "memory.db").alias("has_db"),
        F.bool_or(F.col("path").startswith("memory/")).alias("has_notes"),
    )
    known = config.select("agent_id", F.col("backend").alias("configured"))
    set_to = F.col("configured")
    backend = (
        F.when(set_to == "sqlite", F.when(F.col("has_db"), "table").otherwise("markdown"))
        .when(set_to == "markdown", "markdown")
        .when(set_to.isNotNull(), "none")
        .when(F.col("has_db"), "table")
        .when(F.col("has_notes"), "markdown")
        .otherwise("none")
    )
    return flags.join(known, "agent_id", "left").select("agent_id", backend.alias("backend"))
