"""Records as JSON lines: parse with unknown fields kept, and write back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.checks import rfc3339, rfc3339_text
from memloom.functions.ids import normal_uuid
from memloom.schemas import RECORD_FIELDS, struct_type

_OBJECT = "map<string,variant>"
_LIST = "array<map<string,variant>>"


def json_map(line: Column) -> Column:
    """Top-level fields of a JSON object; null for anything else."""
    return F.from_json(line, _OBJECT)


def opened(line: Column) -> Column:
    """Generator of the field map of a JSON object, no row for anything else.

    A filter on the parsed map would be pushed down and parse every line twice.
    """
    return F.explode(F.array_compact(F.array(json_map(line))))


def canonical_json(m: Column) -> Column:
    """JSON text of a field map with sorted keys; null when the map is empty."""
    return F.nullif(F.to_json(F.to_variant_object(m)), F.lit("{}"))


def unknown_fields(m: Column, known: list[str]) -> Column:
    """Canonical JSON of the fields that are not known, null when there are none."""
    return canonical_json(F.map_filter(m, lambda k, _: ~k.isin(*known)))


def json_text(v: Column) -> Column:
    """Canonical JSON text of a variant."""
    return F.to_json(v)


def _get(m: Column, key: str, typ: str) -> Column:
    return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", typ)


def _fields(ddl: str) -> list[T.StructField]:
    body = ddl[ddl.index("<") + 1:-1]
    if ddl.startswith("array"):
        body = body[body.index("<") + 1:-1]
    return struct_type(body).fields


def _value(m: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.TimestampType):
        return rfc3339(_get(m, field.name, "string"))
    if isinstance(field.dataType, T.ArrayType):
        return _get(m, field.name, "array<double>")
    return _get(m, field.name, field.dataType.simpleString())


def _struct(m: Column, ddl: str) -> Column:
    """Struct of a field map: known fields typed, the others as JSON text in ``extra``."""
    fields = _fields(ddl)
    names = [f.name for f in fields if f.name != "extra"]
    cols = [
        (unknown_fields(m, names) if f.name == "extra" else _value(m, f)).alias(f.name)
        for f in fields
    ]
    return F.struct(*cols)


def _each(items: Column, fn, typ: str) -> Column:
    return F.transform(items, lambda item: fn(item, typ))


def parse_records(df: DataFrame, line: str, keep: Sequence[str] = ()) -> DataFrame:
    """Record columns of JSON lines (D1); lines that are no JSON objects are left out.

    ``line`` names the text column, ``keep`` the columns to carry along.  Unknown fields
    are kept as canonical JSON in ``extra`` at every level.
    """
    maps = df.select(*keep, opened(F.col(line)).alias("_m"))
    return records_of_maps(maps, "_m", keep)


def records_of_maps(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Record columns of field maps (see :func:`json_map`).

    Each JSON text and each nested object is opened once: they are columns of their own
    before their fields are read, so no expression parses them again.
    """
    m = F.col(name)
    nested = [k for k, t in RECORD_FIELDS.items() if t.startswith("struct")]
    opened = df.select(*keep, name, *[_get(m, k, _OBJECT).alias(f"_{k}") for k in nested])
    known = [k for k in RECORD_FIELDS if k != "extra"]
    cols = []
    for field, typ in RECORD_FIELDS.items():
        if field in ("id", "agent_id", "supersedes"):
            raw = _get(m, field, "string")
            col = F.coalesce(normal_uuid(raw), raw)
        elif field == "extra":
            col = unknown_fields(m, known)
        elif field == "raw_source_format":
            # a JSON null counts as absent
            col = F.nullif(json_text(F.try_element_at(m, F.lit(field))), F.lit("null"))
        elif field == "tags":
            col = F.coalesce(_get(m, field, "array<string>"), F.array().cast(typ))
        elif typ.startswith("struct"):
            inner = F.col(f"_{field}")
            col = F.when(inner.isNotNull(), _struct(inner, typ))
        elif typ.startswith("array"):
            items = F.coalesce(_get(m, field, _LIST), F.array().cast(_LIST))
            col = _each(items, _struct, typ)
        else:
            col = _get(m, field, typ)
        cols.append(col.cast(typ).alias(field))
    return opened.select(*keep, *cols)


# --- writing -----------------------------------------------------------------
# Objects are put together as text: known fields through to_json, which leaves nulls
# out, and open fields spliced in as they are.

def _splice(known: Column, more: Column) -> Column:
    """The fields of JSON object ``more`` (may be null) added to object ``known``."""
    rest = F.when(known == "{}", more).otherwise(
        F.concat(F.substr(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substr(more, F.lit(2)))
    )
    return F.when(more.isNull(), known).otherwise(rest)


def _object(s: Column, ddl: str) -> Column:
    """JSON text of a struct with its open fields."""
    cols = []
    for f in _fields(ddl):
        if f.name != "extra":
            value = s[f.name]
            if isinstance(f.dataType, T.TimestampType):
                value = rfc3339_text(value)
            cols.append(value.alias(f.name))
    return _splice(F.to_json(F.struct(*cols)), s["extra"])


def record_json(record: Column | None = None) -> Column:
    """JSON line of a record (D2): nulls and empty lists left out, open fields put back.

    ``record`` is a struct column; without it the record's own columns are used.
    """
    get = (lambda n: F.col(n)) if record is None else (lambda n: record[n])
    plain, parts = [], []
    for name, typ in RECORD_FIELDS.items():
        col = get(name)
        key = F.lit(f'"{name}":')
        if name == "extra":
            continue
        if name == "raw_source_format":
            parts.append(F.when(col.isNotNull(), F.concat(key, col)))
        elif typ.startswith("struct"):
            parts.append(F.when(col.isNotNull(), F.concat(key, _object(col, typ))))
        elif typ.startswith("array<struct"):
            items = F.array_join(_each(col, _object, typ), ",")
            parts.append(F.when(F.size(col) > 0, F.concat(key, F.lit("["), items, F.lit("]"))))
        elif typ.startswith("array"):
            plain.append(F.when(F.size(col) > 0, col).alias(name))
        else:
            plain.append(col.alias(name))
    known = F.to_json(F.struct(*plain))
    # fields of the known part and of `extra` without their braces; nulls are skipped
    inner = lambda text: F.nullif(F.substr(text, F.lit(2), F.length(text) - 2), F.lit(""))
    body = F.concat_ws(",", inner(known), *parts, inner(get("extra")))
    return F.concat(F.lit("{"), body, F.lit("}"))
