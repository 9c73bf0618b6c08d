"""Settings of workspaces, credential hints and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.checks import rfc3339_text
from memloom.functions.ids import uuid5
from memloom.functions.settings import credential_type, is_secret_name, settings
from memloom.schemas import CREDENTIAL_DDL, NOT_EXPORTED, UUID_NAMESPACES, struct_type

_KEY = ["agent_id"]


def setting_rows(files: DataFrame) -> DataFrame:
    """One row per setting of each ``config.toml`` file: ``files(agent_id, path, content)``."""
    return files.where(F.col("path") == "config.toml").select(
        *_KEY, F.explode(settings(F.col("content"))).alias("s")
    ).select(*_KEY, "s.*")


def _pick(section: str, key: str, strings_only: bool = True) -> Column:
    """The value of one setting out of the settings array of a file."""
    hits = F.filter("s", lambda x: (x["section"] == section) & (x["key"] == key)
                    & (x["is_string"] if strings_only else ~x["is_string"]))
    return F.try_element_at(hits, F.lit(1))["value"]


def config_fields(files: DataFrame) -> DataFrame:
    """The settings that matter, with their defaults; one row per settings file."""
    parsed = files.where(F.col("path") == "config.toml").select(
        *_KEY, settings(F.col("content")).alias("s")
    )
    backend = F.lower(F.coalesce(_pick("memory", "backend"), F.lit("sqlite")))
    fmt = F.lower(F.coalesce(_pick("identity", "format"), F.lit("openclaw")))
    flag = lambda section, key: F.coalesce(
        _pick(section, key, False).try_cast("boolean"), F.lit(True)
    )
    number = lambda key, default: F.coalesce(
        _pick("memory", key, False).try_cast("double"), F.lit(default)
    )
    return parsed.select(
        *_KEY,
        F.when(backend.isin("sqlite", "markdown", "none"), backend).otherwise("unsupported")
        .alias("backend"),
        flag("memory", "auto_save").alias("auto_save"),
        F.coalesce(_pick("memory", "embedding_provider"), F.lit("none")).alias("embedding_provider"),
        number("vector_weight", 0.7).alias("vector_weight"),
        number("keyword_weight", 0.3).alias("keyword_weight"),
        F.when(fmt == "aieos", "aieos").otherwise("openclaw").alias("identity_format"),
        _pick("identity", "aieos_path").alias("aieos_path"),
        _pick("identity", "aieos_inline").alias("aieos_inline"),
        flag("secrets", "encrypt").alias("secrets_encrypt"),
        _pick("", "version").alias("runtime_version"),
    )


def credential_hints(files: DataFrame) -> DataFrame:
    """Where settings hold secrets: section, field, service and kind, never the value."""
    rows = setting_rows(files).where(
        F.col("is_string") & is_secret_name(F.col("key")) & ~F.col("section").startswith("[")
    )
    at_root = F.col("section") == ""
    return rows.select(
        *_KEY,
        F.when(at_root, "root").otherwise(F.col("section")).alias("section"),
        F.col("key").alias("field"),
        F.when(at_root, F.col("key"))
        .otherwise(F.replace("section", F.lit("channels_config."), F.lit("channel:")))
        .alias("service"),
        credential_type(F.col("key")).alias("credential_type"),
    )


def credential_rows(hints: DataFrame, as_of: Column) -> DataFrame:
    """Credential metadata of hints; the payload is never exported."""
    name = F.concat_ws(":", "agent_id", F.lit("credential"), "section", "field")
    values = {
        "id": uuid5(UUID_NAMESPACES["record", "zeroclaw"], name),
        "agent_id": F.col("agent_id"),
        "service": F.col("service"),
        "credential_type": F.col("credential_type"),
        "encrypted_payload": F.lit(NOT_EXPORTED),
        "encryption": F.struct(
            F.lit("none").alias("algorithm"), F.lit("none").alias("nonce"),
            F.lit(None).cast("string").alias("kdf"), F.lit(None).cast("string").alias("kdf_params"),
        ),
        "created_at": rfc3339_text(as_of),
        "label": F.concat_ws(".", "section", "field"),
        "capabilities_granted": F.array().cast("array<string>"),
        "tags": F.array().cast("array<string>"),
    }
    return hints.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in struct_type(CREDENTIAL_DDL).fields
    ])
