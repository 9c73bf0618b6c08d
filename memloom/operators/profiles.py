"""Agent names, identities and principals out of workspace files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import notes
from memloom.functions.checks import rfc3339_text
from memloom.functions.ids import uuid5
from memloom.functions.json_records import canonical_json
from memloom.functions.text import h1
from memloom.schemas import IDENTITY_DDL, PRINCIPAL_DDL, UUID_NAMESPACES, struct_of, struct_type

_PERSONA = {"soul": "SOUL.md", "identity_profile": "IDENTITY.md", "operating_instructions": "AGENTS.md"}
_OBJECT = "map<string,variant>"


def persona_files(files: DataFrame) -> DataFrame:
    """The three persona files of each agent side by side (at most three rows per agent)."""
    wanted = files.where(F.col("path").isin(*_PERSONA.values()))
    return wanted.groupBy("agent_id").agg(*[
        F.max(F.when(F.col("path") == path, F.col("content"))).alias(name)
        for name, path in _PERSONA.items()
    ])


def aieos_documents(files: DataFrame, config: DataFrame) -> DataFrame:
    """Persona JSON of each agent that uses the JSON format: its file, else inline."""
    chosen = config.where(F.col("identity_format") == "aieos").select(
        "agent_id", "aieos_path", "aieos_inline"
    )
    in_file = files.select("agent_id", F.col("path").alias("aieos_path"), F.col("content").alias("_doc"))
    return chosen.join(in_file, ["agent_id", "aieos_path"], "left").select(
        "agent_id", F.coalesce("_doc", "aieos_inline").alias("aieos_json")
    ).where(F.col("aieos_json").isNotNull())


def _at(m: Column, path: str, typ: str) -> Column:
    key, _, rest = path.partition(".")
    v = F.try_element_at(m, F.lit(key))
    where = "$" + "".join(f".{p}" for p in rest.split(".") if p)
    kind = {"string": "STRING", "boolean": "BOOLEAN"}.get(typ)
    got = F.try_variant_get(v, where, typ)
    if kind is None:
        return got
    # a number is not taken for a text
    inner = F.try_variant_get(v, where, "variant")
    return F.when(F.schema_of_variant(inner) == kind, got)


def _root(doc: Column) -> Column:
    """Fields of the persona object; an outer ``identity`` wrapper is optional."""
    m = F.from_json(doc, _OBJECT)
    wrapped = F.try_variant_get(F.try_element_at(m, F.lit("identity")), "$", _OBJECT)
    return F.coalesce(wrapped, F.when(~F.map_contains_key(m, "identity"), m))


def _neural_matrix(root: Column) -> Column:
    m = F.try_variant_get(F.try_element_at(root, F.lit("psychology")), "$.neural_matrix", _OBJECT)
    numbers = F.map_filter(
        m, lambda _, v: F.schema_of_variant(v).rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z")
    )
    return F.transform_values(numbers, lambda _, v: F.try_variant_get(v, "$", "double"))


def agent_names(files: DataFrame, workspaces: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Display name of each agent.

    JSON first name, else the first heading of the soul or identity file, else the
    directory name.  ``workspaces``: ``agent_id, workspace``.
    """
    persona = persona_files(files)
    named = workspaces.join(persona, "agent_id", "left")
    first = F.lit(None).cast("string")
    if config is not None:
        named = named.join(aieos_documents(files, config), "agent_id", "left")
        first = _at(_root(F.col("aieos_json")), "names.first", "string")
    folder = F.regexp_extract("workspace", r"([^/]+)/*\z", 1)
    return named.select(
        "agent_id",
        F.coalesce(first, h1(F.col("soul")), h1(F.col("identity_profile")), folder).alias("name"),
    )


def _field(ddl: str, name: str):
    return struct_type(ddl)[name].dataType.simpleString()


def identities(files: DataFrame, as_of: Column, config: DataFrame | None = None) -> DataFrame:
    """Identity document of each agent that has one."""
    docs = persona_files(files)
    if config is not None:
        docs = docs.join(aieos_documents(files, config), "agent_id", "full_outer")
    else:
        docs = docs.withColumn("aieos_json", F.lit(None).cast("string"))
    docs = docs.select(
        "agent_id", "aieos_json", *[notes.non_blank(F.col(c)).alias(c) for c in _PERSONA]
    )
    has_prose = F.coalesce(*_PERSONA).isNotNull()
    docs = docs.where(has_prose | F.col("aieos_json").isNotNull())
    docs = docs.withColumn("_root", _root(F.col("aieos_json")))
    is_json = F.col("aieos_json").isNotNull()
    root = F.col("_root")

    first = _at(root, "names.first", "string")
    heading = F.coalesce(h1(F.col("soul")), h1(F.col("identity_profile")))
    primary = F.coalesce(F.when(is_json, first).otherwise(heading), F.lit("Unknown"))
    named = first.isNotNull()
    structured_t = _field(IDENTITY_DDL, "structured")
    inner = {f.name: f.dataType.simpleString() for f in struct_type(structured_t[7:-1]).fields}
    psychology = struct_of(
        inner["psychology"],
        neural_matrix=_neural_matrix(root),
        moral_alignment=_at(root, "psychology.moral_compass.alignment", "string"),
        mbti=_at(root, "psychology.traits.mbti", "string"),
    )
    linguistics = struct_of(
        inner["linguistics"],
        formality_level=_at(root, "linguistics.text_style.formality_level", "double"),
        slang_usage=_at(root, "linguistics.text_style.slang_usage", "boolean"),
    )
    drive = _at(root, "motivations.core_drive", "string")
    other = F.map_filter(
        root, lambda k, _: ~k.isin("names", "psychology", "linguistics", "motivations")
    )
    has = lambda key: F.coalesce(F.map_contains_key(root, key), F.lit(False))
    structured = struct_of(
        structured_t,
        names=struct_of(
            inner["names"], primary=primary,
            nickname=F.when(named, _at(root, "names.nickname", "string")),
            full=F.when(named, _at(root, "names.full", "string")),
        ),
        goals=F.array_compact(F.array(drive)),
        psychology=F.when(has("psychology"), psychology),
        linguistics=F.when(has("linguistics"), linguistics),
        capabilities=F.array().cast(inner["capabilities"]),
        sub_agents=F.array().cast(inner["sub_agents"]),
        aieos_extensions=canonical_json(other),
    )
    prose = struct_of(
        _field(IDENTITY_DDL, "prose"), **{c: F.col(c) for c in _PERSONA}
    )
    values = {
        "id": uuid5(UUID_NAMESPACES["record", "openclaw"], F.concat("agent_id", F.lit(":identity"))),
        "agent_id": F.col("agent_id"),
        "version": F.lit(1),
        "updated_at": rfc3339_text(as_of),
        "structured": structured,
        "prose": F.when(has_prose, prose),
        "source_format": F.when(is_json, "aieos").otherwise("openclaw"),
        "raw_source": F.when(is_json, F.to_json(F.try_parse_json("aieos_json"))),
    }
    return docs.select(*[
        values[f.name].cast(f.dataType).alias(f.name) for f in struct_type(IDENTITY_DDL).fields
    ])


def principals(files: DataFrame, as_of: Column, runtime: str) -> DataFrame:
    """The user of each agent, from its profile file."""
    users = files.where(F.col("path") == "USER.md").select(
        "agent_id", notes.non_blank(F.col("content")).alias("content")
    ).where(F.col("content").isNotNull())
    ns = UUID_NAMESPACES["record", runtime]
    pid = uuid5(ns, F.concat("agent_id", F.lit(":principal")))
    profile_t = _field(PRINCIPAL_DDL, "profile")
    inner = {f.name: f.dataType.simpleString() for f in struct_type(profile_t[7:-1]).fields}
    plain = runtime == "openclaw"
    profile = struct_of(
        profile_t,
        id=uuid5(ns, F.concat("agent_id", F.lit(":profile"))),
        agent_id=F.col("agent_id"),
        principal_id=pid,
        version=F.lit(1),
        updated_at=rfc3339_text(as_of),
        structured=struct_of(
            inner["structured"],
            name=F.coalesce(h1(F.col("content")), F.lit("User")),
            principal_type=F.lit("human" if plain else None),
            timezone=notes.timezone(F.col("content"), runtime),
            relationships=F.array(),
        ),
        prose=struct_of(inner["prose"], user_profile=F.col("content")),
        source_format=F.lit("openclaw" if plain else None),
    )
    # the owner is the archive's agent; a principal itself names none
    return users.select(
        F.col("agent_id").alias("owner"), pid.alias("id"),
        F.lit("human").alias("principal_type"),
        F.lit(None).cast("string").alias("agent_id"), profile.alias("profile"),
    )
