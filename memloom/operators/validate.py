"""Validation: every rule of a table in one pass over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.checks import is_checksum, is_rfc3339, is_semver
from memloom.functions.ids import is_uuid
from memloom.functions.json_records import json_map
from memloom.schemas import (
    CREDENTIAL_TYPES, FINDING, MEMORY_STATUSES, MEMORY_TYPES, PRINCIPAL_TYPES,
)

E, W = "error", "warning"


def _s(*parts: object) -> Column:
    """Concatenated text; strings are literals, nulls print as nothing."""
    return F.concat(*[
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts
    ])


def finding(severity: str, rule: str, path: Column, message: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
        path.alias("path"), message.alias("message"),
    ).cast(FINDING)


def check(failed: Column, severity: str, rule: str, path: Column, message: Column) -> Column:
    """A one-finding list when ``failed``, else an empty list."""
    none = F.array().cast(f"array<{FINDING}>")
    return F.when(failed, F.array(finding(severity, rule, path, message))).otherwise(none)


def check_each(items: Column, failed, severity: str, rule: str, path, message) -> Column:
    """A finding for every failing list item; the functions get ``(item, index)``."""
    out = F.transform(
        F.coalesce(items, F.array()),
        lambda x, i: F.when(failed(x, i), finding(severity, rule, path(x, i), message(x, i))),
    )
    return F.array_compact(out)


def check_keys(extra: Column, severity: str, rule: str, prefix: Column) -> Column:
    """A finding for every field name of an ``extra`` JSON text."""
    keys = F.coalesce(F.json_object_keys(extra), F.array().cast("array<string>"))
    return F.transform(
        keys,
        lambda k: finding(severity, rule, _s(prefix, ".", k), _s("not a field of the format: ", k)),
    )


def _emit(df: DataFrame, rules: list[Column], keep: list[str]) -> DataFrame:
    found = reduce(lambda a, b: F.concat(a, b), rules)
    return df.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")


def _blank(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(False))


def _keep(df: DataFrame, key: str = "agent_id") -> list[str]:
    return [c for c in (key, "archive") if c in df.columns]


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """Rules V1-V8 over manifest rows."""
    p = lambda s: F.lit(f"manifest.{s}")
    memory = F.col("layers.memory")
    parts = F.coalesce(memory["partitions"], F.array())
    total = F.aggregate(
        parts, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["record_count"], F.lit(0))
    )
    previous = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.arrays_zip(previous.alias("a"), F.slice(parts, 2, F.size(parts) + 1).alias("b"))
    version, checksum = F.col("alf_version"), F.col("checksum")
    rules = [
        check(~F.coalesce(is_semver(version), F.lit(False)), E, "V1", p("alf_version"),
              _s("not a MAJOR.MINOR.PATCH version: '", version, "'")),
        check(_blank(F.col("agent.name")), E, "V2", p("agent.name"), F.lit("agent name is empty")),
        check(_blank(F.col("agent.source_runtime")), E, "V3", p("agent.source_runtime"),
              F.lit("source runtime is empty")),
        check(checksum.isNotNull() & ~is_checksum(checksum), E, "V4", p("checksum"),
              _s("not an 'algorithm:hex' checksum: '", checksum, "'")),
        check(memory.isNotNull() & (memory["record_count"] != total), E, "V5", p("layers.memory"),
              _s("record_count ", memory["record_count"], " but partitions hold ", total)),
        check_each(
            pairs, lambda x, i: x["b"]["from"] < x["a"]["from"], E, "V6",
            lambda x, i: p("layers.memory.partitions"),
            lambda x, i: _s("'", x["b"]["file"], "' (", x["b"]["from"], ") comes after '",
                            x["a"]["file"], "' (", x["a"]["from"], ")"),
        ),
        check_each(
            parts, lambda x, i: x["sealed"] & x["to"].isNull(), E, "V7",
            lambda x, i: _s("manifest.layers.memory.partitions[", i, "]"),
            lambda x, i: _s("sealed partition '", x["file"], "' has no end date"),
        ),
        check_keys(F.col("extra"), W, "V8", F.lit("manifest")),
    ]
    return _emit(manifests, rules, _keep(manifests))


def validate_records(records: DataFrame) -> DataFrame:
    """Rules V9-V16 over records; paths count by ``ord.pos``."""
    prefix = _s("records[", F.col("ord.pos"), "]")
    p = lambda s: _s(prefix, f".{s}")
    c = F.col
    rules = [
        check(_blank(c("content")), E, "V9", p("content"), F.lit("content is empty")),
        check(_blank(c("namespace")), E, "V10", p("namespace"), F.lit("namespace is empty")),
        check(F.coalesce(~c("confidence").between(0.0, 1.0), F.lit(False)), E, "V11",
              p("confidence"), _s("confidence outside 0 to 1: ", c("confidence"))),
        check_each(
            c("embeddings"), lambda x, i: x["dimensions"] != F.size(x["vector"]), E, "V12",
            lambda x, i: _s(prefix, ".embeddings[", i, "]"),
            lambda x, i: _s("dimensions ", x["dimensions"], " but ", F.size(x["vector"]), " values"),
        ),
        check(_blank(c("source.runtime")), E, "V13", p("source.runtime"),
              F.lit("source runtime is empty")),
        check(~c("memory_type").isin(*MEMORY_TYPES), W, "V14", p("memory_type"),
              _s("memory_type not in the list: ", c("memory_type"), ", read as semantic")),
        check(~c("status").isin(*MEMORY_STATUSES), W, "V15", p("status"),
              _s("status not in the list: ", c("status"), ", read as active")),
        check_keys(c("extra"), W, "V16", prefix),
    ]
    return _emit(records, rules, _keep(records))


def validate_identities(identities: DataFrame) -> DataFrame:
    """Rules V17-V21 over identity documents."""
    s = F.col("structured")
    item = lambda field: (lambda x, i: _s(f"identity.structured.{field}[", i, "].name"))
    nameless = lambda x, i: x["name"] == ""
    rules = [
        check(F.col("version") < 1, E, "V17", F.lit("identity.version"),
              _s("version below 1: ", F.col("version"))),
        check(_blank(s["names"]["primary"]), E, "V18", F.lit("identity.structured.names.primary"),
              F.lit("primary name is empty")),
        check_each(s["capabilities"], nameless, E, "V19", item("capabilities"),
                   lambda x, i: F.lit("capability name is empty")),
        check_each(s["sub_agents"], nameless, E, "V20", item("sub_agents"),
                   lambda x, i: F.lit("sub-agent name is empty")),
    ]
    if "extra" in identities.columns:
        rules.append(check_keys(F.col("extra"), W, "V21", F.lit("identity")))
    return _emit(identities, rules, _keep(identities))


def validate_principals(principals: DataFrame) -> DataFrame:
    """Rules V22-V24 over principals keyed by ``owner``; paths count by ``pos``."""
    pos = F.col("pos") if "pos" in principals.columns else F.lit(0)
    p = lambda s: _s("principals[", pos, f"].{s}")
    profile = F.col("profile")
    rules = [
        check(profile["version"] < 1, E, "V22", p("profile.version"),
              _s("profile version below 1: ", profile["version"])),
        check(profile["principal_id"] != F.col("id"), E, "V23", p("profile.principal_id"),
              _s("profile names ", profile["principal_id"], ", principal is ", F.col("id"))),
        check(~F.col("principal_type").isin(*PRINCIPAL_TYPES), W, "V24", p("principal_type"),
              _s("principal_type not in the list: ", F.col("principal_type"), ", read as human")),
    ]
    found = _emit(principals, rules, _keep(principals, "owner"))
    return found.withColumnRenamed("owner", "agent_id")


def validate_credentials(credentials: DataFrame) -> DataFrame:
    """Rules V25-V29 over credential rows; paths count by ``pos``."""
    pos = F.col("pos") if "pos" in credentials.columns else F.lit(0)
    p = lambda s: _s("credentials[", pos, f"].{s}")
    c = F.col
    empty = {
        "V25": "service", "V26": "encrypted_payload",
        "V27": "encryption.algorithm", "V28": "encryption.nonce",
    }
    rules = [
        check(_blank(c(field)), E, rule, p(field), F.lit(f"{field} is empty"))
        for rule, field in empty.items()
    ]
    rules.append(
        check(~c("credential_type").isin(*CREDENTIAL_TYPES), W, "V29", p("credential_type"),
              _s("credential_type not in the list: ", c("credential_type"), ", read as custom"))
    )
    return _emit(credentials, rules, _keep(credentials))


def validate_links(
    manifests: DataFrame, identities: DataFrame | None = None, records: DataFrame | None = None
) -> DataFrame:
    """Rules V30 and V31: layers against the manifest of their agent or archive."""
    key = "archive" if "archive" in manifests.columns else "agent_id"
    keep = list(dict.fromkeys(["agent_id", key]))
    m = manifests.select(
        *keep, F.col("agent.id").alias("_agent"), F.col("layers.memory.record_count").alias("_count")
    )
    out = []
    if identities is not None:
        named = identities.select(F.col(key).alias("_k"), F.col("agent_id").alias("_named"))
        j = m.join(named, F.col(key) == F.col("_k"))
        out.append(_emit(j, [check(
            F.col("_named") != F.col("_agent"), E, "V30", F.lit("identity.agent_id"),
            _s("identity belongs to ", F.col("_named"), ", manifest to ", F.col("_agent")),
        )], keep))
    if records is not None:
        n = records.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        j = m.join(n, F.col(key) == F.col("_k"))
        out.append(_emit(j, [check(
            F.col("_count").isNotNull() & (F.col("_count") != F.col("_n")), E, "V31",
            F.lit("manifest.layers.memory.record_count"),
            _s("manifest counts ", F.col("_count"), " records, archive holds ", F.col("_n")),
        )], keep))
    return reduce(lambda a, b: a.unionByName(b), out)


# --- raw lines ---------------------------------------------------------------

_REQUIRED = ("id", "agent_id", "content", "memory_type", "status", "namespace")
# fixed values: the types fields are written in, as patterns of type names
_TEXT, _NUMBER, _WHOLE, _OBJECT = r"\ASTRING\z", r"\A(BIGINT|DOUBLE|DECIMAL.*)\z", r"\A(BIGINT|DECIMAL\(\d+,0\))\z", r"\AOBJECT<"
_TEXTS, _NUMBERS, _OBJECTS = r"\AARRAY<(STRING|VOID)>\z", r"\AARRAY<(BIGINT|DOUBLE|DECIMAL.*|VOID)>\z", r"\AARRAY<(OBJECT<.*|VOID)>\z"
_KINDS = {
    **{name: _TEXT for name in ("id", "agent_id", "content", "memory_type", "status", "namespace", "category", "supersedes")},
    **{f"source.{name}": _TEXT for name in (
        "runtime", "runtime_version", "origin", "origin_file", "extraction_method", "session_id", "interaction_id")},
    "source.identity_version": _WHOLE, "temporal.access_count": _WHOLE,
    "confidence": _NUMBER, "source": _OBJECT, "temporal": _OBJECT, "tags": _TEXTS,
    "entities": _OBJECTS, "embeddings": _OBJECTS, "related_records": _OBJECTS,
}
_ITEM_KINDS = {
    "entities": {"name": _TEXT, "type": _TEXT},
    "embeddings": {"model": _TEXT, "vector": _NUMBERS, "source": _TEXT},
    "related_records": {"relation": _TEXT},
}
_IDS = ("id", "agent_id", "supersedes")
_TIMES = (
    "created_at", "updated_at", "observed_at", "valid_from", "valid_until", "last_accessed_at",
)


# a record as a plain reader would type it; `_corrupt_record` marks what does not fit
_TYPED = (
    "id string, agent_id string, content string, memory_type string, status string, namespace string, "
    "category string, supersedes string, confidence double, "
    "source struct<runtime:string,runtime_version:string,origin:string,origin_file:string,extraction_method:string,"
    "session_id:string,interaction_id:string,identity_version:bigint>, "
    f"temporal struct<{','.join(f'{t}:string' for t in _TIMES)},access_count:bigint>, "
    "entities array<struct<name:string,type:string>>, "
    "embeddings array<struct<model:string,dimensions:bigint,vector:array<double>,computed_at:string,source:string>>, "
    "related_records array<struct<id:string,relation:string>>, _corrupt_record string"
)
# Values that a typed reader takes although they have another type than the field's: anything
# but a text where a text belongs, a text where a number belongs.
# The value is looked at first, then the key before it: most keys have values of their type.
_LOOSE = (
    r'"(?:(?=\s*+:\s*+[^"\s])(?<="(?:id|agent_id|content|memory_type|status|namespace|category|supersedes|runtime|'
    r'runtime_version|origin|origin_file|extraction_method|session_id|interaction_id|created_at|updated_at|observed_at|'
    r'last_accessed_at|computed_at|valid_from|valid_until|name|type|model|relation)")|'
    r'(?=\s*+:\s*+[^-0-9\s])(?<="(?:confidence|identity_version|access_count|dimensions)")|'
    r'(?=\s*+:\s*+[^"{\s])(?<="source")|[-+]?(?:NaN|Infinity|INF)")'
)


def _loose(line: Column) -> Column:
    """Whether a value may be of such a type; keys in single quotes or with escaped letters count."""
    quoted = F.when(line.contains("'"), line.rlike(r"'\s*+:")).otherwise(F.lit(False))
    escaped = F.when(line.contains("\\u00"), line.rlike(r"\\u00[4-7]")).otherwise(F.lit(False))
    return line.rlike(_LOOSE) | quoted | escaped


def _trusted(m: Column, t: Column, line: Column) -> Column:
    """Whether the typed form ``t`` of a line says the same as its field map ``m``.

    False wherever any value might have another type than its field's; these lines are
    looked at value by value.
    """
    def incomplete(field: str) -> Column:
        return F.exists(t[field], lambda x: reduce(lambda a, b: a | b, [x[n].isNull() for n in _ITEM_KINDS[field]]))

    tags = F.try_element_at(m, F.lit("tags"))
    doubts = [
        ~line.rlike(r"\A\s*+\{"), t["_corrupt_record"].isNotNull(), _loose(line),
        F.size(F.array_distinct(F.map_keys(m))) < F.size(m),
        F.when(tags.isNotNull(), ~F.schema_of_variant(tags).rlike(_TEXTS)),
        *[incomplete(field) for field in _ITEM_KINDS], F.exists(t["embeddings"], lambda e: e["source"].startswith("{")),
    ]
    return reduce(lambda a, b: a & b, [F.coalesce(~d, F.lit(True)) for d in doubts], m.isNotNull() & t.isNotNull())


def validate_lines(lines: DataFrame) -> DataFrame:
    """Rules P1-P5 over raw record lines: ``partition, line_number, line``.

    These stop the reader that works record by record; here they are findings, so one
    bad line does not hide the others.  A line is parsed once as a field map and once into
    typed columns.  Where these can be relied on, all rules read them; types are looked at
    value by value only where a value of another type is there or cannot be ruled out.
    """
    keep = [c for c in ("agent_id", "archive", "partition", "line_number") if c in lines.columns]
    m, t, typed = F.col("_m"), F.col("_t"), F.col("_typed")
    v = lambda key: F.try_element_at(m, F.lit(key))

    def kind(x: Column) -> Column:
        """Type name of a value; null for an absent one, VOID for a JSON null."""
        return F.when(x.isNotNull(), F.schema_of_variant(x))

    def leaf(name: str, typ: str) -> Column:
        key, _, rest = name.partition(".")
        return F.try_variant_get(v(key), f"$.{rest}" if rest else "$", typ)

    def text(name: str) -> Column:
        """Text of a field; null for absent and JSON null."""
        key, _, rest = name.partition(".")
        known = t[key][rest] if rest else t[key]
        return F.when(typed, known.cast("string")).otherwise(leaf(name, "string"))

    def parts(field: str, wanted: dict[str, str]) -> Column:
        """(name, kind, wanted) of the required fields of each item of a list."""
        items = F.try_variant_get(v(field), "$", "array<variant>")
        return F.flatten(F.transform(items, lambda x, i: F.array(*[
            F.struct(F.concat(F.lit(f".{field}["), i.cast("string"), F.lit(f"].{name}")).alias("name"),
                     F.coalesce(kind(F.try_variant_get(x, f"$.{name}", "variant")), F.lit("VOID")).alias("kind"),
                     F.lit(w).alias("wanted"))
            for name, w in wanted.items()])))

    required = [*_REQUIRED, "source.runtime", "temporal.created_at"]
    times = [f"temporal.{x}" for x in _TIMES]
    numbers = ["source.identity_version", "temporal.access_count"]
    names = list(dict.fromkeys([*required, *_IDS, *times, *numbers]))
    link, vector = "array<struct<id:string>>", "array<struct<computed_at:string,dimensions:string>>"
    parsed = lines.select(
        *keep, _s(F.col("partition"), ":", F.col("line_number")).alias("_at"), "line",
        json_map(F.col("line")).alias("_m"), F.from_json("line", _TYPED).alias("_t"))
    parsed = parsed.select(*keep, "_at", "_m", "_t", _trusted(m, t, F.col("line")).alias("_typed"))
    read = parsed.select(
        *keep, "_at", m.isNull().alias("_broken"),
        *[text(name).alias(f"_{name.replace('.', '_')}") for name in names],
        *[F.when(~typed, kind(v(name) if "." not in name else leaf(name, "variant"))).alias(f"_kind_{name.replace('.', '_')}")
          for name in _KINDS],
        F.when(~typed, F.concat(*[F.coalesce(parts(f, w), F.array()) for f, w in _ITEM_KINDS.items()])).alias("_parts"),
        F.when(typed, F.transform(t["related_records"], lambda x: F.struct(x["id"].alias("id"))))
        .otherwise(F.try_variant_get(v("related_records"), "$", link)).alias("_links"),
        F.when(typed, F.transform(t["embeddings"], lambda x: F.struct(
            x["computed_at"].alias("computed_at"), x["dimensions"].cast("string").alias("dimensions"))))
        .otherwise(F.try_variant_get(v("embeddings"), "$", vector)).alias("_vectors"),
    )
    at = F.col("_at")
    here = lambda x, i: F.concat(at, x["name"])
    within = lambda items, field: (
        lambda x, i: _s(at, f".{items}[", i, f"].{field}")
    )
    bad = lambda test: F.coalesce(~test, F.lit(True))
    upto = lambda bits: F.lit(str(2**bits - 1)).cast("decimal(20,0)")
    is_whole = lambda c, top: c.rlike(r"\A[0-9]{1,20}\z") & (c.try_cast("decimal(20,0)") <= top)
    no_uuid = lambda c: _s("not a UUID: '", c, "'")
    no_time = lambda c: _s("not an RFC 3339 instant: '", c, "'")
    no_number = lambda c: _s("not a whole number from 0: ", c)
    wrong_kind = lambda c: _s("not of the field's type: ", c)
    known = ~F.col("_broken")

    def fields(of: list[str], rule: str, failed, message, prefix: str = "_") -> Column:
        """A finding for every field whose value fails; ``failed`` gets value and name."""
        out = []
        for name in of:
            x = F.col(prefix + name.replace(".", "_"))
            out.append(F.when(failed(x, name), finding(E, rule, F.concat(at, F.lit(f".{name}")), message(x))))
        return F.array_compact(F.array(*out))

    rules = [
        check(F.col("_broken"), E, "P1", at, F.lit("not a JSON object")),
        fields(required, "P2", lambda x, _: known & x.isNull(), lambda x: F.lit("required field missing")),
        fields(list(_KINDS), "P2", lambda x, name: (x != "VOID") & ~x.rlike(_KINDS[name]), wrong_kind, "_kind_"),
        check_each(F.col("_parts"), lambda x, i: ~F.rlike(x["kind"], x["wanted"]), E, "P2", here,
                   lambda x, i: wrong_kind(x["kind"])),
        fields(list(_IDS), "P3", lambda x, _: ~is_uuid(x), no_uuid),
        check_each(F.col("_links"), lambda x, i: bad(is_uuid(x["id"])), E, "P3",
                   within("related_records", "id"), lambda x, i: no_uuid(x["id"])),
        fields(times, "P4", lambda x, _: ~is_rfc3339(x), no_time),
        check_each(F.col("_vectors"), lambda x, i: bad(is_rfc3339(x["computed_at"])), E, "P4",
                   within("embeddings", "computed_at"), lambda x, i: no_time(x["computed_at"])),
        fields(numbers, "P5", lambda x, name: ~is_whole(x, upto(64 if name.endswith("access_count") else 32)), no_number),
        check_each(F.col("_vectors"), lambda x, i: bad(is_whole(x["dimensions"], upto(32))), E, "P5",
                   within("embeddings", "dimensions"), lambda x, i: no_number(x["dimensions"])),
    ]
    return _emit(read, rules, keep)


def missing_entries(required: DataFrame, entries: DataFrame) -> DataFrame:
    """Rule P6: archive entries a manifest names (``archive, entry``) that are not there."""
    gone = required.join(entries.select("archive", "entry"), ["archive", "entry"], "left_anti")
    keep = [c for c in ("agent_id", "archive") if c in required.columns]
    return _emit(gone, [check(
        F.lit(True), E, "P6", F.col("entry"), F.lit("entry missing from archive")
    )], keep)


# --- reports -----------------------------------------------------------------

def merge(*findings: DataFrame) -> DataFrame:
    """All findings of several validators."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)


def errors(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == E)


def warnings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == W)


def validity(subjects: DataFrame, findings: DataFrame, key: str = "agent_id") -> DataFrame:
    """``is_valid`` and counts per subject; warnings do not make it invalid."""
    counts = findings.groupBy(key).agg(
        F.count_if(F.col("severity") == E).alias("errors"),
        F.count_if(F.col("severity") == W).alias("warnings"),
    )
    return subjects.select(key).distinct().join(counts, key, "left").na.fill(
        0, ["errors", "warnings"]
    ).withColumn("is_valid", F.col("errors") == 0)


def fail_fast(findings: DataFrame) -> None:
    """Raise on the first error found; reads no more than one row to the driver."""
    first = errors(findings).limit(1).collect()
    if first:
        raise ValueError(f"{first[0].rule} at {first[0].path}: {first[0].message}")


def validate(
    manifests: DataFrame,
    records: DataFrame | None = None,
    identities: DataFrame | None = None,
    principals: DataFrame | None = None,
    credentials: DataFrame | None = None,
) -> DataFrame:
    """Findings of every rule over the layers given (V0)."""
    found = [validate_manifests(manifests)]
    if records is not None:
        found.append(validate_records(records))
    if identities is not None:
        found.append(validate_identities(identities))
    if principals is not None:
        found.append(validate_principals(principals))
    if credentials is not None:
        found.append(validate_credentials(credentials))
    if identities is not None or records is not None:
        found.append(validate_links(manifests, identities, records))
    return merge(*found)
