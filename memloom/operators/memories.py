"""Records out of note files and memory tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions import notes
from memloom.functions.checks import rfc3339
from memloom.functions.ids import native_id, record_id
from memloom.operators.sections import split_sections
from memloom.schemas import AUTO_SAVE_PREFIX, RECORD_FIELDS, record_columns, struct_of

_SOURCE = RECORD_FIELDS["source"]
_TEMPORAL = RECORD_FIELDS["temporal"]
_EMBEDDING = RECORD_FIELDS["embeddings"][len("array<"):-1]


def _raw_section() -> Column:
    return F.to_json(
        F.struct("heading", "line_end", "line_start"), {"ignoreNullFields": "false"}
    )


def _with_runtime_version(df: DataFrame) -> Column:
    if "runtime_version" in df.columns:
        return F.col("runtime_version")
    return F.lit(None)


def openclaw_records(files: DataFrame) -> DataFrame:
    """Records of Markdown note files.

    ``files``: ``agent_id, path, content, mtime``.  Dated files are observed at midnight
    of their date; all others are created at their file time.
    """
    parts = split_sections(files)
    path = F.col("path")
    day = notes.daily_date(path).cast("timestamp")
    tagged = parts.withColumn("_space", notes.namespace(path)).withColumn("_day", day)
    tagged = tagged.withColumn("_tags", notes.section_tags(F.col("content"), F.col("_space")))
    return tagged.select(*record_columns(
        agent_id=F.col("agent_id"),
        id=record_id("openclaw", path, F.col("section_index")),
        content=F.col("content"),
        memory_type=notes.memory_type(path),
        status=F.lit("active"),
        namespace=F.col("_space"),
        category=F.col("_tags.category"),
        confidence=F.col("_tags.confidence"),
        source=struct_of(
            _SOURCE, runtime=F.lit("openclaw"), origin=F.lit("workspace"), origin_file=path,
            extraction_method=notes.extraction_method(path),
        ),
        temporal=struct_of(
            _TEMPORAL, created_at=F.coalesce("_day", "mtime"), updated_at=F.col("mtime"),
            observed_at=F.col("_day"),
        ),
        tags=F.col("_tags.tags"),
        raw_source_format=_raw_section(),
    ))


def zeroclaw_note_records(files: DataFrame) -> DataFrame:
    """Records of dated, session and other note files, archived ones included."""
    parts = split_sections(files, whole_files=False)
    parts = parts.withColumn("_class", notes.archive_file_class(F.col("path")))
    parts = parts.withColumn("_day", F.col("_class.observed_on").cast("timestamp"))
    space, status = F.col("_class.namespace"), F.col("_class.status")
    return parts.select(*record_columns(
        agent_id=F.col("agent_id"),
        id=record_id("zeroclaw", F.col("path"), F.col("section_index")),
        content=F.col("content"),
        memory_type=F.col("_class.memory_type"),
        status=status,
        namespace=space,
        category=space,
        source=struct_of(
            _SOURCE, runtime=F.lit("zeroclaw"), runtime_version=_with_runtime_version(parts),
            origin=F.lit("workspace"), origin_file=F.col("path"),
            extraction_method=F.lit("agent_written"),
        ),
        temporal=struct_of(
            _TEMPORAL, created_at=F.coalesce("_day", "mtime"), observed_at=F.col("_day")
        ),
        tags=F.array_compact(
            F.array(space, F.lit("zeroclaw"), F.when(status == "archived", F.lit("archived")))
        ),
        raw_source_format=_raw_section(),
    ))


# --- embeddings --------------------------------------------------------------

_MIN_DIMS, _MAX_DIMS = 64, 4096


def _unpack(dtype: str):
    """Arrow UDF from packed floats to doubles; a closure, so workers need no install."""

    def unpack(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in blobs:
            there = np.flatnonzero(s.notna())
            packed = s.iloc[there].tolist()
            values = np.frombuffer(b"".join(packed), dtype=dtype).astype("f8")
            ends = np.cumsum([0, *map(len, packed)]) // np.dtype(dtype).itemsize
            out = [None] * len(s)
            for i, a, b in zip(there, ends, ends[1:]):
                out[i] = values[a:b]
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(unpack, T.ArrayType(T.DoubleType()))


def embedding_layout(blob: Column) -> Column:
    """``f32``, ``f64`` or null by length alone.

    Four-byte floats win where both fit, so eight-byte vectors are only seen when they
    are too long to be four-byte ones.
    """
    n = F.octet_length(blob)
    fits = lambda width: (n % width == 0) & (n / width).between(_MIN_DIMS, _MAX_DIMS)
    return F.when(fits(4), "f32").when(fits(8), "f64")


def embedding_model(layout: Column, provider: Column) -> Column:
    """Model name of a vector, null when the provider writes none."""
    return (
        F.when((layout == "f32") & (provider == "openai"), "openai/text-embedding-3-small")
        .when((layout == "f32") & ~provider.isin("none", "noop"), provider)
        .when(layout == "f64", F.concat(F.lit("unknown/"), provider))
    )


def decode_embeddings(df: DataFrame, blob: str, provider: Column, at: Column, name: str) -> DataFrame:
    """Add ``name``: the embedding list of a packed vector, empty when unreadable.

    Length and provider rules stay in Catalyst; only vectors that will be kept go
    through Arrow.
    """
    layout = embedding_layout(F.col(blob))
    df = df.withColumn("_layout", layout).withColumn(
        "_model", embedding_model(F.col("_layout"), provider)
    )
    wanted = lambda kind: F.when(
        F.col("_model").isNotNull() & (F.col("_layout") == kind), F.col(blob)
    )
    df = df.withColumn("_f32", wanted("f32")).withColumn("_f64", wanted("f64"))
    df = df.withColumn("_vector", F.coalesce(_unpack("<f4")("_f32"), _unpack("<f8")("_f64")))
    one = struct_of(
        _EMBEDDING, model=F.col("_model"), dimensions=F.size("_vector"), vector=F.col("_vector"),
        computed_at=at, source=F.lit("runtime"),
    )
    empty = F.array().cast(f"array<{_EMBEDDING}>")
    return df.withColumn(
        name, F.when(F.col("_vector").isNotNull(), F.array(one)).otherwise(empty)
    ).drop("_layout", "_model", "_f32", "_f64", "_vector")


def zeroclaw_table_records(rows: DataFrame, as_of: Column, provider: Column | None = None) -> DataFrame:
    """Records of memory table rows.

    ``rows``: ``agent_id, id, key, content, category, timestamp, embedding`` and
    optionally ``embedding_provider`` and ``runtime_version``.  Ids that are no UUIDs
    are derived, unreadable times become ``as_of``.
    """
    if provider is None:
        provider = (
            F.coalesce("embedding_provider", F.lit("none"))
            if "embedding_provider" in rows.columns else F.lit("none")
        )
    rows = rows.withColumn("_at", rfc3339(F.col("timestamp"), as_of))
    rows = decode_embeddings(rows, "embedding", provider, F.col("_at"), "_embeddings")
    kind = notes.category_class(F.col("category"))
    auto = F.col("key").startswith(AUTO_SAVE_PREFIX)
    return rows.select(*record_columns(
        agent_id=F.col("agent_id"),
        id=native_id(F.col("id"), F.col("agent_id"), "zeroclaw"),
        content=F.col("content"),
        memory_type=kind["memory_type"],
        status=F.lit("active"),
        namespace=kind["namespace"],
        category=F.col("category"),
        source=struct_of(
            _SOURCE, runtime=F.lit("zeroclaw"), runtime_version=_with_runtime_version(rows),
            origin=F.lit("sqlite"), extraction_method=F.lit("agent_written"),
        ),
        temporal=struct_of(_TEMPORAL, created_at=F.col("_at")),
        tags=F.array_compact(
            F.array(F.col("category"), F.lit("zeroclaw"), F.when(auto, F.lit("auto_save")))
        ),
        embeddings=F.col("_embeddings"),
        raw_source_format=F.to_json(F.struct("category", "key"), {"ignoreNullFields": "false"}),
    ))
