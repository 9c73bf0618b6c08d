"""Snapshot and delta archives as tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.json_records import (
    json_map, opened, parse_records, records_of_maps, unknown_fields,
)
from memloom.functions.text import trim
from memloom.operators.validate import fail_fast, validate_lines
from memloom.schemas import (
    ARCHIVE_GLOB, ATTACHMENT_DDL, CREDENTIAL_DDL, DELTA_GLOB, DELTA_MANIFEST_DDL,
    IDENTITY_DDL, MANIFEST_DDL, ORD, PRINCIPAL_DDL, RECORD_FIELDS, struct_type,
)
from memloom.sources.files import list_files, named, with_content

ENTRY_DDL = (
    "archive string, agent_id string, entry string, role string, place int, first_pos bigint, "
    "base_sequence bigint, delta_seq bigint, data binary"
)
# unpacked bytes handed back to Spark at a time
OUTPUT_BYTES = 8 << 20
LAYERS = ("identity", "principals", "credentials", "attachments")


def _reader(kind: str, roles: frozenset[str] | None):
    """Task function over (path, content) batches.

    Opens each archive, reads only the members whose role is wanted and emits them in
    batches of bounded size.  ``first_pos`` is how many non-blank lines the memory files before it hold,
    so list positions need no shuffle later.
    """
    manifest_name = "manifest.json" if kind == "snapshot" else "delta-manifest.json"
    layers = LAYERS
    budget = OUTPUT_BYTES

    def named_files(manifest: dict[str, Any]) -> list[tuple[str, str]]:
        """(role, entry) of every layer file the manifest names, partitions in its order."""
        listed = manifest.get("layers" if kind == "snapshot" else "changes") or {}
        out = [
            (layer, listed[layer]["file"])
            for layer in layers
            if isinstance(listed.get(layer), dict) and listed[layer].get("file")
        ]
        memory = listed.get("memory") or {}
        if kind == "snapshot":
            out += [("memory", p["file"]) for p in memory.get("partitions") or []]
        elif memory.get("file"):
            out.append(("memory", memory["file"]))
        return out

    def members(name: str, content: bytes) -> Iterator[tuple]:
        try:
            box = zipfile.ZipFile(io.BytesIO(content))
            manifest_data = box.read(manifest_name)
            manifest = json.loads(manifest_data)
        except (zipfile.BadZipFile, KeyError, ValueError) as problem:
            yield name, None, manifest_name, "unreadable", 0, 0, None, None, str(problem).encode()
            return
        agent = (manifest.get("agent") or {}).get("id")
        base = seq = None
        if kind == "delta":
            # a delta without a number of its own follows its base
            sync = manifest.get("sync") or {}
            base = int(sync.get("base_sequence") or 0)
            seq = max(int(sync.get("new_sequence") or 0), base + 1)
        if roles is None or "manifest" in roles:
            yield name, agent, manifest_name, "manifest", 0, 0, base, seq, manifest_data
        present = set(box.namelist())
        named = named_files(manifest)
        lines_before = 0
        for place, (role, entry) in enumerate(named):
            if roles is not None and role not in roles:
                continue
            if entry not in present:
                yield name, agent, entry, "missing", place, 0, base, seq, None
                continue
            data = box.read(entry)
            yield name, agent, entry, role, place, lines_before, base, seq, data
            if role == "memory":
                text = data.decode("utf-8", "replace")
                lines_before += sum(1 for line in text.split("\n") if line.strip())
        if roles is None or "file" in roles:
            known = {manifest_name, *(entry for _, entry in named)}
            for entry in box.namelist():
                if entry not in known and not entry.endswith("/"):
                    yield name, agent, entry, "file", 0, 0, base, seq, box.read(entry)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [
            "archive", "agent_id", "entry", "role", "place", "first_pos", "base_sequence",
            "delta_seq", "data",
        ]
        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for row in members(name, content):
                    rows.append(row)
                    size += len(row[-1] or b"") + 256
                    if size >= budget:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return read


def scan_archives(
    spark: SparkSession, path: str, kind: str = "snapshot", roles: Sequence[str] | None = None
) -> DataFrame:
    """Entries of every archive under ``path``.

    ``role`` is ``manifest``, a layer, ``memory``, ``file`` for everything else,
    ``missing`` for an entry the manifest names but the archive lacks, or
    ``unreadable``.  ``roles`` limits which members are unpacked at all.  Archives are
    found whatever their names and dealt out to all tasks.
    """
    found = list_files(spark, path).where(named(ARCHIVE_GLOB if kind == "snapshot" else DELTA_GLOB))
    blobs = with_content(found.select("uri").repartition("uri"), "content")
    return unpack(blobs.select(F.col("uri").alias("path"), "content"), kind, roles)


def unpack(
    blobs: DataFrame, kind: str = "snapshot", roles: Sequence[str] | None = None
) -> DataFrame:
    """Entries of archives given as ``path, content`` rows, whatever source they come from."""
    wanted = None if roles is None else frozenset(roles)
    return blobs.mapInPandas(_reader(kind, wanted), ENTRY_DDL)


def stage_archives(spark: SparkSession, path: str, staging: str, kind: str = "snapshot") -> DataFrame:
    """Unpack every archive once into a table partitioned by role, and read it from there.

    Each scan with its own roles reads the archives again; a job that needs most layers
    stages them and lets role filters prune directories instead.
    """
    scan_archives(spark, path, kind).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("role").parquet(staging)
    columns = [f.name for f in struct_type(ENTRY_DDL).fields]
    return spark.read.schema(ENTRY_DDL).parquet(staging).select(*columns)


def _text(entries: DataFrame, role: str) -> DataFrame:
    return entries.where(F.col("role") == role).withColumn("_text", F.col("data").cast("string"))


def manifests(entries: DataFrame) -> DataFrame:
    """One manifest row per snapshot archive; unknown fields in ``extra``."""
    known = struct_type(MANIFEST_DDL).names
    df = _text(entries, "manifest").select(
        "archive", "agent_id", F.from_json("_text", MANIFEST_DDL).alias("m"),
        unknown_fields(json_map(F.col("_text")), known).alias("extra"),
    )
    return df.select("archive", "agent_id", "m.*", "extra")


def memory_lines(entries: DataFrame) -> DataFrame:
    """Non-blank lines of memory files with their partition, line number and position (S3).

    Line numbers start at 1 and count blank lines; positions start at 0 over all
    partitions of the archive and do not.
    """
    df = _text(entries, "memory")
    numbered = F.transform(
        F.split("_text", "\n"),
        lambda line, i: F.struct((i + 1).cast("bigint").alias("line_number"), trim(line).alias("line")),
    )
    kept = F.filter(numbered, lambda x: x["line"] != "")
    return df.select(
        "archive", "agent_id", F.col("entry").alias("partition"), "first_pos", "base_sequence",
        "delta_seq", F.posexplode(kept).alias("_i", "_l"),
    ).select(
        "archive", "agent_id", "base_sequence", "delta_seq", "partition", "_l.line_number",
        (F.col("first_pos") + F.col("_i")).cast("bigint").alias("pos"), "_l.line",
    )


def records_of_lines(lines: DataFrame) -> DataFrame:
    """Records of lines from :func:`memory_lines` or :func:`text_lines`.

    Lines that are no records are left out; :func:`validate_lines` reports them.
    """
    keep = [c for c in ("archive", "pos") if c in lines.columns]
    parsed = parse_records(lines, "line", keep)
    out = [F.col(c) for c in ("archive",) if c in keep]
    if "pos" in keep:
        out.append(F.struct(F.lit(0).alias("delta"), F.col("pos").alias("pos")).cast(ORD).alias("ord"))
    return parsed.select(*out, *RECORD_FIELDS)


def scan_records(entries: DataFrame, mode: str = "report") -> DataFrame:
    """All records of the archives in manifest order (S3).

    ``mode="failfast"`` raises on the first bad line, as a record-by-record reader would.
    """
    if mode not in ("report", "failfast"):
        raise ValueError("mode must be 'report' or 'failfast'")
    lines = memory_lines(entries)
    if mode == "failfast":
        fail_fast(validate_lines(lines))
    return records_of_lines(lines)


def text_lines(lines: DataFrame) -> DataFrame:
    """Record lines of a plain directory of JSON lines, batch or stream.

    ``lines``: the ``value`` column of a text scan.  No positions; order by time.
    """
    cut = lines.select(trim(F.col("value")).alias("line"))
    return cut.where(F.col("line") != "")


def scan_layer(entries: DataFrame, layer: str) -> DataFrame:
    """Documents of one layer.

    One row per identity; one row per principal, credential or attachment with its
    list position ``pos``.  ``owner`` is the agent of the archive.
    """
    df = _text(entries, layer)
    if layer == "identity":
        known = struct_type(IDENTITY_DDL).names
        return df.select(
            "archive", F.col("agent_id").alias("owner"), F.from_json("_text", IDENTITY_DDL).alias("d"),
            unknown_fields(json_map(F.col("_text")), known).alias("extra"),
        ).select("archive", "owner", "d.*", "extra")
    ddl = {"principals": PRINCIPAL_DDL, "credentials": CREDENTIAL_DDL, "attachments": ATTACHMENT_DDL}
    if layer not in ddl:
        raise ValueError(f"unknown layer {layer!r}, known: {', '.join(LAYERS)}")
    items = struct_type(ddl[layer])
    doc = F.from_json("_text", f"struct<{layer}:array<{items.simpleString()}>>")
    rows = df.select(
        "archive", F.col("agent_id").alias("owner"), F.posexplode(doc[layer]).alias("pos", "d")
    ).select("archive", "owner", "pos", "d.*")
    return rows if "agent_id" in items.names else rows.withColumn("agent_id", F.col("owner"))


def scan_layer_documents(entries: DataFrame) -> DataFrame:
    """Replaceable layers as whole documents: ``agent_id, layer, seq, doc``.

    ``seq`` is the sequence of the delta, 0 for a snapshot.
    """
    layers = entries.where(F.col("role").isin("identity", "principals", "credentials"))
    return layers.select(
        "agent_id", F.col("role").alias("layer"),
        F.coalesce("delta_seq", F.lit(0)).cast("bigint").alias("seq"),
        F.col("data").cast("string").alias("doc"),
    )


def broken_documents(entries: DataFrame) -> DataFrame:
    """Rule P1 over a scan: layers that are no JSON objects, or lists their items are not in,
    and lines of delta entries that are no JSON objects or name no operation."""
    layers = entries.where(F.col("role").isin(*LAYERS)).select(
        "archive", "agent_id", "entry", "role", json_map(F.col("data").cast("string")).alias("m"))
    item = F.try_variant_get(F.try_element_at("m", F.col("role")), "$", "array<map<string,variant>>")
    wrong = F.when(F.col("m").isNull(), "not a JSON object").when(
        (F.col("role") != "identity") & item.isNull(), "no list of objects under the layer's name")
    documents = layers.select("archive", "agent_id", F.col("entry").alias("path"), wrong.alias("message"))
    lines = memory_lines(entries).where("delta_seq IS NOT NULL").select(
        "archive", "agent_id", "partition", "line_number", json_map(F.col("line")).alias("m"))
    operation = F.try_variant_get(F.try_element_at("m", F.lit("operation")), "$", "string")
    wrong = F.when(F.col("m").isNull(), "not a JSON object").when(operation.isNull(), "no operation")
    place = F.concat_ws(":", "partition", F.col("line_number").cast("string"))
    changes = lines.select("archive", "agent_id", place.alias("path"), wrong.alias("message"))
    return documents.unionByName(changes).where("message IS NOT NULL").select(
        "archive", "agent_id", F.lit("error").alias("severity"), F.lit("P1").alias("rule"), "path", "message")


def missing(entries: DataFrame) -> DataFrame:
    """Rule P6 over a scan: unreadable archives and entries that are not there."""
    return entries.where(F.col("role").isin("missing", "unreadable")).select(
        "archive", F.lit("error").alias("severity"), F.lit("P6").alias("rule"),
        F.col("entry").alias("path"),
        F.coalesce(F.col("data").cast("string"), F.lit("entry missing from archive")).alias("message"),
    )


def delta_manifests(entries: DataFrame) -> DataFrame:
    """One manifest row per delta archive, with the sequence it is applied at."""
    df = _text(entries, "manifest").select(
        "archive", "agent_id", "base_sequence", "delta_seq",
        F.from_json("_text", DELTA_MANIFEST_DDL).alias("m"),
    )
    return df.select("archive", "agent_id", "m.*", "base_sequence", "delta_seq")


def scan_deltas(entries: DataFrame) -> DataFrame:
    """Delta entries with their position in the delta.

    A delete may carry no more than ids.
    """
    keep = ["archive", "base_sequence", "delta_seq", "pos", "operation"]
    parsed = memory_lines(entries).select(*keep[:-1], opened(F.col("line")).alias("_m"))
    operation = F.try_variant_get(F.try_element_at("_m", F.lit("operation")), "$", "string")
    body = F.map_filter("_m", lambda k, _: k != "operation")
    rows = parsed.select(*keep[:-1], operation.alias("operation"), body.alias("_b"))
    return records_of_maps(rows, "_b", keep).withColumn("delta_seq", F.col("delta_seq").cast("bigint"))
