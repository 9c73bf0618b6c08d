"""Schemas and fixed values shared by every operator.

A *record* is one memory of one agent.  The fleet key is ``(agent_id, id)``;
``ord`` is the place of a record in its agent's list: ``(0, pos)`` for rows of
a snapshot and ``(k, pos)`` for rows created by delta ``k``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "struct<delta:bigint,pos:bigint>"

RECORD_FIELDS: dict[str, str] = {
    "agent_id": "string",
    "id": "string",
    "content": "string",
    "memory_type": "string",
    "status": "string",
    "namespace": "string",
    "category": "string",
    "supersedes": "string",
    "confidence": "double",
    "source": (
        "struct<runtime:string,runtime_version:string,origin:string,origin_file:string,"
        "extraction_method:string,session_id:string,interaction_id:string,"
        "identity_version:bigint,extra:string>"
    ),
    "temporal": (
        "struct<created_at:timestamp,updated_at:timestamp,observed_at:timestamp,"
        "valid_from:timestamp,valid_until:timestamp,last_accessed_at:timestamp,"
        "access_count:bigint,extra:string>"
    ),
    "entities": "array<struct<name:string,type:string,role:string,extra:string>>",
    "tags": "array<string>",
    "embeddings": (
        "array<struct<model:string,dimensions:bigint,vector:array<double>,"
        "computed_at:timestamp,source:string,extra:string>>"
    ),
    "related_records": "array<struct<id:string,relation:string,extra:string>>",
    "raw_source_format": "string",
    "extra": "string",
}

PARTITION_INFO = (
    "struct<file:string,from:date,to:date,record_count:bigint,sealed:boolean>"
)

MANIFEST_DDL = (
    "alf_version string, created_at string, "
    "agent struct<id:string,name:string,source_runtime:string,source_runtime_version:string>, "
    "layers struct<identity:struct<version:bigint,file:string>,"
    "principals:struct<count:bigint,file:string>,credentials:struct<count:bigint,file:string>,"
    "memory:struct<record_count:bigint,index_file:string,"
    f"partitions:array<{PARTITION_INFO}>,has_embeddings:boolean,has_raw_source:boolean>,"
    "attachments:struct<count:bigint,file:string,included_count:bigint,"
    "included_size_bytes:bigint,referenced_count:bigint,referenced_size_bytes:bigint>>, "
    "runtime_hints struct<primary_model:string,last_model:string,provider:string,"
    "context_window:bigint,notes:string>, "
    "sync struct<last_sequence:bigint,last_sync_at:string>, "
    "raw_sources array<string>, checksum string"
)

DELTA_MANIFEST_DDL = (
    "alf_version string, created_at string, "
    "agent struct<id:string,source_runtime:string>, "
    "sync struct<base_sequence:bigint,new_sequence:bigint,base_timestamp:string,"
    "new_timestamp:string>, "
    "changes struct<identity:struct<file:string,new_version:bigint>,"
    "principals:struct<file:string,changed_ids:array<string>>,"
    "credentials:struct<file:string>,memory:struct<file:string,record_count:bigint>>"
)

_CAPABILITY = (
    "struct<name:string,description:string,priority:bigint,portability:string,"
    "host_requirements:string,credential_ids:array<string>>"
)

IDENTITY_DDL = (
    "id string, agent_id string, version bigint, updated_at string, "
    "structured struct<names:struct<primary:string,nickname:string,full:string>,role:string,"
    "goals:array<string>,psychology:struct<neural_matrix:map<string,double>,"
    "personality_traits:struct<framework:string,scores:map<string,double>>,"
    "moral_alignment:string,mbti:string>,"
    "linguistics:struct<formality_level:double,verbosity:double,humor_level:double,"
    "slang_usage:boolean,preferred_language:string,idiolect:struct<catchphrases:array<string>,"
    "verbal_tics:array<string>,avoided_words:array<string>>>,"
    f"capabilities:array<{_CAPABILITY}>,"
    f"sub_agents:array<struct<agent_id:string,name:string,capabilities:array<{_CAPABILITY}>,"
    "status:string,description:string,model_hints:struct<primary_model:string,last_model:string>,"
    "routing_hints:string,last_invoked_at:string,performance_notes:string>>,"
    "aieos_extensions:string>, "
    "prose struct<soul:string,operating_instructions:string,identity_profile:string,"
    "custom_blocks:map<string,string>>, source_format string, raw_source string"
)

PRINCIPAL_DDL = (
    "id string, principal_type string, agent_id string, "
    "profile struct<id:string,agent_id:string,principal_id:string,version:bigint,"
    "updated_at:string,structured:struct<name:string,principal_type:string,timezone:string,"
    "locale:string,communication_preferences:struct<tone:string,response_length:string,"
    "formatting:string>,work_context:struct<role:string,company:string,"
    "projects:array<string>>,relationships:array<string>,custom_fields:string>,"
    "prose:struct<user_profile:string>,source_format:string,raw_source:string>"
)

CREDENTIAL_DDL = (
    "id string, agent_id string, service string, credential_type string, "
    "encrypted_payload string, encryption struct<algorithm:string,nonce:string,kdf:string,"
    "kdf_params:string>, created_at string, label string, capabilities_granted array<string>, "
    "updated_at string, last_rotated_at string, expires_at string, tags array<string>"
)

ATTACHMENT_DDL = (
    "id string, filename string, media_type string, size_bytes bigint, "
    "hash struct<algorithm:string,value:string>, source_path string, archive_path string, "
    "remote_ref string, referenced_by array<string>"
)

FINDING = "struct<severity:string,rule:string,path:string,message:string>"

MEMORY_ROW_DDL = (
    "agent_id string, id string, key string, content string, category string, "
    "timestamp string, embedding binary"
)

# Fixed values of the interchange format ------------------------------------

MEMORY_TYPES = ("semantic", "episodic", "procedural", "preference", "summary")
MEMORY_STATUSES = ("active", "superseded", "archived", "deleted")
PRINCIPAL_TYPES = ("human", "agent")
# the absent credential module is only visible through its uses
CREDENTIAL_TYPES = ("api_key", "oauth_token", "secret", "custom")
DELTA_OPERATIONS = ("create", "update", "delete")

UUID_NAMESPACES = {
    # ASCII bytes of the namespace, as hex
    ("record", "openclaw"): b"openclaw-alf-ns1".hex(),
    ("record", "zeroclaw"): b"zeroclaw-alf-ns1".hex(),
    ("agent", "openclaw"): b"alf-agent-id-ns1".hex(),
    ("agent", "zeroclaw"): b"alf-zclw-agent-1".hex(),
}

AGENT_ID_FILE = ".alf-agent-id"
FORMAT_VERSION = "1.0.0"
ARCHIVE_GLOB = "*.alf"
DELTA_GLOB = "*.alf-delta"
MEMORY_INDEX_FILE = "memory/index.json"
DELTA_ENTRIES_FILE = "memory/delta.jsonl"

ROOT_FILES = {
    "openclaw": (
        "SOUL.md", "IDENTITY.md", "AGENTS.md", "USER.md",
        "TOOLS.md", "HEARTBEAT.md", "BOOTSTRAP.md", "MEMORY.md",
    ),
    "zeroclaw": (
        "SOUL.md", "IDENTITY.md", "AGENTS.md", "USER.md", "TOOLS.md", "HEARTBEAT.md",
    ),
}

AUTO_SAVE_PREFIX = "assistant_autosave_"
REDACTED = "<redacted>"
NOT_EXPORTED = "<not-exported>"


@lru_cache(maxsize=None)
def struct_type(ddl: str) -> T.StructType:
    """StructType of a DDL string."""
    return T.StructType.fromDDL(ddl)


def record_columns(**values: Column) -> list[Column]:
    """All record fields in schema order; fields not given are null or empty."""
    unknown = set(values) - set(RECORD_FIELDS)
    if unknown:
        raise ValueError(f"not record fields: {sorted(unknown)}")
    out = []
    for name, typ in RECORD_FIELDS.items():
        if name in values:
            col = values[name].cast(typ)
        elif typ.startswith("array"):
            col = F.array().cast(typ)
        else:
            col = F.lit(None).cast(typ)
        out.append(col.alias(name))
    return out


@lru_cache(maxsize=None)
def _fields(ddl: str) -> tuple[tuple[str, str], ...]:
    body = ddl[len("struct<"):-1] if ddl.startswith("struct<") else ddl
    return tuple((f.name, f.dataType.simpleString()) for f in struct_type(body).fields)


def struct_of(ddl: str, **values: Column) -> Column:
    """A struct with every field of ``ddl``; fields not given are null."""
    fields = _fields(ddl)
    unknown = set(values) - {name for name, _ in fields}
    if unknown:
        raise ValueError(f"not fields of the struct: {sorted(unknown)}")
    return F.struct(*[
        values.get(name, F.lit(None)).cast(typ).alias(name) for name, typ in fields
    ])
