"""Identifiers: deterministic version-5 UUIDs and normalised native ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import trim
from memloom.schemas import UUID_NAMESPACES

_HYPHENATED = r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_ANY_UUID = rf"\A([0-9a-fA-F]{{32}}|{_HYPHENATED}|\{{{_HYPHENATED}\}}|urn:uuid:{_HYPHENATED})\z"


def _hyphenate(h: Column) -> Column:
    return F.concat_ws(
        "-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)
    )


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of ``name`` in a 16-byte namespace given as hex."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.translate(h.substr(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"),
        variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12),
    )


def record_id(runtime: str, path: Column, index: Column) -> Column:
    """Id of the ``index``-th section of a file."""
    name = F.concat(path, F.lit(":"), index.cast("string"))
    return uuid5(UUID_NAMESPACES["record", runtime], name)


def is_uuid(c: Column) -> Column:
    """Plain, hyphenated, braced and urn spellings are accepted."""
    return c.rlike(_ANY_UUID)


def normal_uuid(c: Column) -> Column:
    """Lower-case hyphenated spelling of a UUID, null when it is none."""
    digits = F.lower(F.regexp_replace(c, r"urn:uuid:|[{}-]", ""))
    return F.when(is_uuid(c), _hyphenate(digits))


def native_id(raw: Column, agent_id: Column, runtime: str) -> Column:
    """The native id when it is a UUID, else a UUID derived from agent and raw id."""
    derived = uuid5(UUID_NAMESPACES["record", runtime], F.concat(agent_id, F.lit(":"), raw))
    return F.coalesce(normal_uuid(raw), derived)


def agent_id(stored: Column, workspace: Column, runtime: str) -> Column:
    """The stored agent id, else one derived from the workspace path."""
    derived = uuid5(UUID_NAMESPACES["agent", runtime], workspace)
    return F.coalesce(normal_uuid(trim(stored)), derived)
