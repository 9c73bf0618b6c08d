"""What the operators of this package share: blocks of an Arrow batch, word spans, hashes, stored tables.

Texts are handled as the bytes of an Arrow column.  ``blocks`` cuts a batch so that the
arrays made from it stay small; ``word_spans`` and ``span_hash`` work on a whole block
at once.
"""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.session import configure, shared_dir

#: Text bytes of one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

#: Groups of a sample whose narrow rows are broadcast.
FEW_GROUPS = 100_000

BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of words between white space.
PLAIN = np.array([b not in _SPACES for b in range(256)])
#: Bytes of words of ASCII letters and digits and of everything beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)  # bounds an Arrow batch by bytes
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from; a null id is no such row."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below the folder all executors share, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom-runs/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables; only when whatever is made from them is written, too."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let the driver drop what finished jobs left.

    Spark deletes shuffle files only when the driver collects its garbage; between many short
    jobs its heap grows to its bound first.  For operators of many jobs, between their steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_runs(spark: SparkSession) -> None:
    """Delete the tables of all runs; only when no result of theirs is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/memloom-runs")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame) -> Column:
    """All columns but ``doc_id`` and ``text`` in one struct ``given``, out of the way of any name."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.struct(F.lit(None).cast("int").alias(""), *others).alias("given")


def restored(columns: list[str]) -> list[Column]:
    """The columns of a table whose others were put ``aside``."""
    return [F.col(c) if c in ("doc_id", "text") else F.col("given").getField(c).alias(c) for c in columns]


def sample_by(rows: DataFrame, by: str, n: int) -> DataFrame:
    """About ``n`` different values of ``digest`` for each value of ``by``, with all their rows.

    A digest is in or out by its own bits alone, against a share that comes from the number
    of digests of its group, so nothing is ranked and no group meets in one task.  There may
    be any number of groups; their shares are sent to every task while they are ``FEW_GROUPS``
    or less, and joined beyond.
    """
    span = 1 << 40
    share = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.approx_count_distinct("digest", 0.02).alias("_n"))
    share = stored(share.select(by, (F.lit(float(n)) / F.col("_n") * span).cast("long").alias("_share")), "shares")
    few = F.broadcast(share) if share.count() <= FEW_GROUPS else share
    return rows.join(few, by).where(F.pmod("digest", F.lit(span)) < F.col("_share")).drop("_share")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Every row of ``batches``, in slices of about ``BLOCK_BYTES`` of ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: none) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][: len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of true places; no run goes on into the next row."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_spans(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z) of a column, and start, end and row of its words."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    return data, *spans(kind[data], offsets)


def coded_words(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct runs of bytes ``inside``, and the place there and the row of every run."""
    starts, ends, rows = spans(inside, offsets)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    runs = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    coded = runs.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), rows


def best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, with their ``rank`` from 1.

    First among those of one of 64 lots of partitions, then among what is left of these.
    """
    lot = rows.withColumn("_lot", F.pmod(F.spark_partition_id(), F.lit(64)))
    nth = F.row_number().over(Window.partitionBy(by, "_lot").orderBy(*order))
    few = lot.withColumn("rank", nth).where(F.col("rank") <= k).drop("_lot", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        powers = np.full(n, base, np.uint64)
        powers[:1] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``codes``: equal spans have equal hashes anywhere."""
    n = len(codes)
    powers, inverse = _powers(max(1 << 21, 1 << n.bit_length()))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def chain_hash(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``k`` consecutive words of one row, and the place of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h = h * BASE + hashes[i: n + i]
    first = np.flatnonzero(rows[:n] == rows[k - 1:])
    return mix(h[first]), first


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def widened(schema: T.StructType, **kinds: str) -> T.StructType:
    """A copy of ``schema`` with more fields; ``add`` alone would change that of its DataFrame."""
    out = T.StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out
