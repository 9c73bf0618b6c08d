"""SimHash fingerprints, and their near pairs through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import blocks, stored, widened
from memloom.llm.components import components

BITS = 64
#: Fingerprints of one index before it is split into pairs of chunks.
CHUNK = 8192
#: Children of an index node.
FANOUT = 8
#: Node pairs opened in one step; each makes up to FANOUT ** 2 new ones.
FRONTIER = 1 << 14


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits over XXH64 of all word shingles of ``text``; 0 where there are none."""
    tokens = (text or "").encode().lower().split()  # both know ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for first in range(0, n, 1 << 14):  # a very long text takes no more memory than a short one
        last = min(n, first + (1 << 14))
        a = starts[first:last].tolist()
        b = ends[np.minimum(np.arange(first, last) + words, len(tokens)) - 1].tolist()
        hashes = np.array([digest(joined[x:y], 42) for x, y in zip(a, b)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (bigint holding the 64 bits), which it must not have yet."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))],
                                             names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(add, widened(docs.schema, fingerprint="long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    codes = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        codes ^= codes >> np.uint64(shift)
    return codes


def _segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of ``distance`` + 1 segments: near codes are equal in one of them."""
    edges = [round(i * BITS / (distance + 1)) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of everything connected, after linking ``a`` with ``b``."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            next_ = labels[labels]
            if (next_ == labels).all():
                break
            labels = next_


def link_groups(groups: np.ndarray, codes: np.ndarray, distance: int) -> np.ndarray:
    """For each code the place of the first code of its group it is linked with, itself included.

    Codes of a group are sorted by Gray rank.  Every ``FANOUT`` neighbours get a node that
    holds the bits all of them share, and so on up to one root for the group.  Two nodes
    differ in at least as many bits as their shared patterns do, so a pair of nodes over
    ``distance`` is dropped with everything below.  A pair whose codes are all connected
    already is dropped, too: a dense group of near copies costs no look at all its pairs.
    """
    order = np.lexsort((gray_rank(codes), groups))
    groups, codes = groups[order], codes[order]
    n = len(codes)
    labels = np.arange(n)
    for lag in (1, 2, 3):
        near = (groups[lag:] == groups[:-lag]) & (np.bitwise_count(codes[lag:] ^ codes[:-lag]) <= distance)
        labels = _settle(labels, np.flatnonzero(near), np.flatnonzero(near) + lag)

    # levels from the leaves up: first child of each node, bits set in all and in any code
    levels = [(np.arange(n), groups, codes, codes)]
    while True:
        _, of, every, some = levels[-1]
        begin = np.r_[True, of[1:] != of[:-1]]
        if begin.all():
            break
        start = np.maximum.accumulate(np.where(begin, np.arange(len(of)), 0))
        first = np.flatnonzero((np.arange(len(of)) - start) % FANOUT == 0)
        levels.append((first, of[first], np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)))

    roots = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, roots, roots)]
    lows: list[np.ndarray] = []

    def uniform() -> None:
        """Smallest and largest label below every node, as far as links are known."""
        lows[:] = [labels]
        highs = [labels]
        for first, *_ in levels[1:]:
            lows.append(np.minimum.reduceat(lows[-1], first))
            highs.append(np.maximum.reduceat(highs[-1], first))
        for k, high in enumerate(highs):
            lows[k] = np.where(lows[k] == high, lows[k], -1)

    uniform()
    while todo:
        level, a, b = todo.pop()
        if level and len(a) > FRONTIER:
            todo.append((level, a[FRONTIER:], b[FRONTIER:]))
            a, b = a[:FRONTIER], b[:FRONTIER]
        _, _, every, some = levels[level]
        apart = np.bitwise_count((every[a] & ~some[b]) | (every[b] & ~some[a]))
        keep = (apart <= distance) & ((lows[level][a] != lows[level][b]) | (lows[level][a] < 0))
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            labels = _settle(labels, a, b)
            uniform()
            continue
        first = np.r_[levels[level][0], len(levels[level - 1][0])]
        wide, high = first[a + 1] - first[a], first[b + 1] - first[b]
        pairs = wide * high
        which = np.repeat(np.arange(len(a)), pairs)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left, right = first[a][which] + nth // high[which], first[b][which] + nth % high[which]
        half = left <= right
        todo.append((level - 1, left[half], right[half]))

    out = np.empty(n, np.int64)
    out[order] = order[labels]
    return out


def near_edges(codes: DataFrame, distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct ``fingerprint`` values within ``distance`` bits.

    Not every near pair is given, but a forest that connects the same values.  Values that
    near each other agree in one of ``distance`` + 1 segments of their bits, which is the
    top level of the index: each value goes to one group a segment, and each group has its
    own hierarchical index.  A group over ``chunk`` values is split into chunks, and every
    two chunks share an index, so no task holds a group of any size.
    """
    codes = codes.select("fingerprint").distinct()
    keys = F.array(*[
        F.struct(F.lit(i).alias("segment"),
                 F.shiftrightunsigned(F.col("fingerprint"), at).bitwiseAND((1 << width) - 1).alias("bits"))
        for i, (at, width) in enumerate(_segments(distance))
    ])
    entries = codes.select("fingerprint", F.explode(keys).alias("key")).select(
        "fingerprint", (F.col("key.segment") * (1 << 32) + F.col("key.bits")).alias("key"))
    large = entries.groupBy("key").count().where(F.col("count") > chunk).select(
        "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    entries = entries.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    entries = entries.select("fingerprint", "key", "chunks", own.alias("own")).select(
        "fingerprint", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    entries = entries.select("fingerprint", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        change = np.lexsort(group[::-1])
        sorted_ = group[:, change]
        numbers = np.empty(table.num_rows, np.int64)
        numbers[change] = np.cumsum(np.r_[False, (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)])
        values = table.column("fingerprint").to_numpy()
        root = link_groups(numbers, values.view(np.uint64), distance)
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_pydict({"u": values[linked], "v": values[root[linked]]})

    return entries.repartition("key", "i", "j").mapInArrow(link, "u long, v long")


def near_components(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every document.

    ``component_id`` is the smallest id that a chain of fingerprints within ``distance``
    bits leads to.  Copies share a fingerprint, so only distinct fingerprints are searched
    and connected.  Null and empty texts have fingerprint 0 and are linked like any other;
    null ids are no candidates for the smallest (null where a component has no other);
    repeated rows stay repeated; an empty table gives none.  Only ``doc_id`` and ``text``
    are read.
    """
    rows = stored(fingerprints(docs.select("doc_id", "text"), words).drop("text"), "fingerprints")
    roots = components(near_edges(rows, distance))
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, least["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
