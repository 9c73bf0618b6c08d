"""Workspace inventories, issues and export reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import trim
from memloom.schemas import AGENT_ID_FILE

_FLAGS = {
    "soul_md": "SOUL.md", "identity_md": "IDENTITY.md", "agents_md": "AGENTS.md",
    "user_md": "USER.md", "memory_md": "MEMORY.md", "active_context": "memory/active-context.md",
}


def workspace_inventory(files: DataFrame) -> DataFrame:
    """What each workspace holds (W1): ``files(workspace, path, content)``.

    Daily logs are counted by the shape of the name only, at the top of ``memory/``.
    """
    path = F.col("path")
    name = F.when(path.rlike(r"\Amemory/[^/]+\z"), F.expr("substring(path, 8)"))
    daily = (F.octet_length(name) == 13) & name.endswith(".md") & (F.substring(name, 5, 1) == "-")
    project = name.startswith("project-") & name.endswith(".md")
    # contents stay behind: what is sorted by workspace is a path and, in one file of each, an id
    own = F.when(path == AGENT_ID_FILE, trim(F.col("content")))
    stored = F.max("_own")
    return files.select("workspace", "path", own.alias("_own")).groupBy("workspace").agg(
        *[F.bool_or(path == p).alias(n) for n, p in _FLAGS.items()],
        F.bool_or(path.startswith("memory/")).alias("memory_dir"),
        F.count_if(daily).alias("daily_logs"),
        F.max(F.when(daily, name)).alias("latest_daily"),
        F.count_if(project).alias("project_files"),
        F.nullif(stored, F.lit("")).alias("agent_id"),
    )


def workspace_issues(inventory: DataFrame) -> DataFrame:
    """Warnings about a workspace."""
    c = F.col
    any_md = c("soul_md") | c("identity_md") | c("agents_md") | c("user_md") | c("memory_md")
    rules = [
        ("workspace_empty", ~any_md, "no Markdown files at the workspace root"),
        ("no_soul_md", ~c("soul_md"), "SOUL.md is missing"),
        ("no_memory_content", ~(c("memory_md") | (c("memory_dir") & (c("daily_logs") > 0))),
         "neither MEMORY.md nor daily logs"),
        ("memory_dir_empty", c("memory_dir") & (c("daily_logs") == 0),
         "memory/ has no daily logs"),
    ]
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code"),
                              F.lit(text).alias("message")))
        for code, cond, text in rules
    ]))
    return inventory.select("workspace", F.explode(found).alias("i")).select("workspace", "i.*")


def export_report(manifests: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Per agent: name, counts of each layer and of raw files.

    Names of raw files stay rows of ``raw_files``; a workspace may hold any number.
    """
    raw = raw_files.groupBy("agent_id").agg(F.count(F.lit(1)).alias("_raw"))
    layers = F.col("layers")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return manifests.join(raw, "agent_id", "left").select(
        "agent_id",
        F.col("agent.name").alias("agent_name"),
        "alf_version",
        count(layers["memory"]["record_count"]).alias("memory_records"),
        layers["identity"]["version"].alias("identity_version"),
        count(layers["principals"]["count"]).alias("principals_count"),
        count(layers["credentials"]["count"]).alias("credentials_count"),
        count(layers["attachments"]["count"]).alias("attachments_count"),
        count(F.col("_raw")).alias("raw_source_count"),
    )
