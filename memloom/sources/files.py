"""Files below a folder, whatever their names: listed in tasks, read in bounded batches.

Spark's own file sources leave out every name that begins with ``_`` or ``.``; the data
here has such names, so listing and reading are done from the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "uri string, path string, size bigint, mtime timestamp"
# content bytes handed back to Spark at a time
BATCH_BYTES = 16 << 20


def _opener():
    """A function of a place to its file system and the path in it, for use inside tasks."""

    def of(place: str):
        from pyarrow import fs

        scheme, colon, rest = place.partition(":")
        if not colon or scheme == "file":
            return fs.LocalFileSystem(), "/" + (rest if colon else place).lstrip("/")
        return fs.FileSystem.from_uri(place)

    return of


def _lister(recursive: bool, folders: bool):
    """Task function over ``base, uri`` rows: what lies below each ``uri``.

    ``path`` is relative to ``base``.  With ``folders``, folders are listed too (with no
    size) so that a further step can open them.
    """
    of = _opener()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["base", "uri", "path", "size", "mtime", "folder"]).astype(
                {"size": "int64", "folder": "bool", "mtime": "datetime64[us]"})

        for batch in batches:
            rows = []
            for base, uri in zip(batch["base"], batch["uri"]):
                system, where = of(uri)
                root = of(base)[1].rstrip("/")
                for x in system.get_file_info(fs.FileSelector(where, recursive=recursive, allow_not_found=True)):
                    is_file = x.type == fs.FileType.File
                    if is_file or folders and x.type == fs.FileType.Directory:
                        path = x.path[len(root):].lstrip("/")
                        when = x.mtime.replace(tzinfo=None) if x.mtime is not None else None
                        rows.append((base, f"{base}/{path}", path, x.size or 0 if is_file else 0, when, not is_file))
                    if len(rows) >= 10_000:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    return read


_FOUND = "base string, uri string, path string, size bigint, mtime timestamp, folder boolean"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: ``uri``, ``path`` relative to it, ``size`` and ``mtime``.

    One task lists the folder itself; the folders in it are dealt out to all tasks, which
    list everything below them.
    """
    base = root.rstrip("/")
    start = spark.createDataFrame([(base, base)], "base string, uri string")
    top = start.mapInPandas(_lister(False, True), _FOUND)
    below = top.where("folder").select("base", "uri").repartition("uri").mapInPandas(_lister(True, False), _FOUND)
    return top.where("NOT folder").unionByName(below).select("uri", "path", "size", "mtime")


def with_content(files: DataFrame, name: str = "data") -> DataFrame:
    """``files`` with the bytes at ``uri``, read in batches of bounded size."""
    of, budget, columns = _opener(), BATCH_BYTES, files.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size, first = [], 0, 0
            for i, uri in enumerate(batch["uri"]):
                system, where = of(uri)
                with system.open_input_stream(where) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= budget:
                    yield batch.iloc[first:i + 1].assign(**{name: held})
                    held, size, first = [], 0, i + 1
            if held:
                yield batch.iloc[first:].assign(**{name: held})

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.select(*columns).mapInPandas(read, f"{schema}, `{name}` binary")


def named(pattern: str, column: str = "path") -> Column:
    """Whether the last part of a path fits a glob of ``*`` and plain characters."""
    like = "".join(".*" if c == "*" else c if c.isalnum() else f"\\{c}" for c in pattern)
    return F.substring_index(column, "/", -1).rlike(rf"\A{like}\z")
