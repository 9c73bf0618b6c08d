"""Benchmark items inside documents: size-partitioned MinHash search, verified by containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm.common import ALNUM, blocks, chain_hash, lookup, mix, span_hash, stored, word_spans

SHINGLE = 5
THRESHOLD = 0.8
#: Minima of a signature; one in common makes a candidate.
MINIMA = 64
#: Items of so few shingles are looked up by the hashes themselves: minima would miss some by chance.
FEW_SHINGLES = 4
#: Shingles of the smallest size class; every further class is twice as wide.
TILE = 8
#: Words of the items that are searched for in one pass over the documents.
BLOCK_WORDS = 2_000_000

_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64))


def size_class(shingles: int) -> int:
    """Class of an item: the smallest with ``TILE * 2 ** class`` shingles or more."""
    return max(0, (max(shingles, 1) - 1) // TILE).bit_length()


def _marks(size: int) -> np.ndarray:
    """What tells the minima of a size class and of each function from others."""
    return mix(np.uint64(size * MINIMA + 1) + np.arange(MINIMA, dtype=np.uint64))


def _key(minimum: np.ndarray, size: int, nth: int) -> np.ndarray:
    return minimum ^ _marks(size)[nth]


def _owners(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ``keys`` that are equal to that at ``first``: which of ``first``, and the place."""
    n = np.searchsorted(keys, keys[first], "right") - first
    of = np.repeat(np.arange(len(first)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Items:
    """A block of items: for each its id, distinct shingle hashes and shingles, and an index
    of its signature.  ``short`` has, by the words of a shingle, the sorted hashes of items of
    ``FEW_SHINGLES`` or less, and their owners."""

    ids: list = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    shingles: list[set[bytes]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    likely: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Items:
        out = Items()
        data, starts, ends, rows = word_spans(pa.array(texts, pa.string()), ALNUM)
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        hashes = span_hash(data, starts, ends)
        keys, owners = [np.zeros(0, np.uint64)], []
        few: dict[int, list[tuple[int, int]]] = {}
        for i, item_id in enumerate(ids):
            own = slice(edges[i], edges[i + 1])
            n = edges[i + 1] - edges[i]
            if not n:
                continue
            k = min(SHINGLE, n)
            h = np.unique(chain_hash(hashes[own], np.zeros(n, np.int64), k)[0])
            words = [data[a:b].tobytes() for a, b in zip(starts[own], ends[own])]
            place = len(out.ids)
            out.ids.append(item_id)
            out.hashes.append(h)
            out.shingles.append({b" ".join(words[j: j + k]) for j in range(n - k + 1)})
            out.sizes.append(k)
            if len(h) <= FEW_SHINGLES:
                few.setdefault(k, []).extend((x, place) for x in h.tolist())
            else:
                lowest = (h[:, None] * _FACTORS + _SHIFTS).min(axis=0)
                keys.append(lowest ^ _marks(size_class(len(h))))
                owners += [place] * MINIMA
        for k, pairs in few.items():
            pairs.sort()
            out.short[k] = np.array([h for h, _ in pairs], np.uint64), np.array([p for _, p in pairs], np.int64)
        keys, owners = np.concatenate(keys), np.array(owners, np.int64)
        order = np.argsort(keys, kind="stable")
        out.keys, out.owners = keys[order], owners[order]
        out.likely = np.zeros(1 << 16, bool)
        out.likely[(out.keys >> np.uint64(48)).astype(np.int64)] = True
        return out

    def classes(self) -> set[int]:
        return {size_class(len(h)) for h in self.hashes if len(h) > FEW_SHINGLES}

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Pairs of a row and the first place in ``keys`` of a minimum that one of its windows has.

        A class of up to u shingles looks at windows of 2u shingles, u apart: whatever is
        no longer than u stands whole in one of them.  Minima of narrow windows make those
        of wide ones, so every shingle is hashed once for each minimum.
        """
        wanted = self.classes()
        if not wanted or not len(hashes):
            return np.zeros((2, 0), np.int64)
        begin = np.r_[True, rows[1:] != rows[:-1]]
        start = np.maximum.accumulate(np.where(begin, np.arange(len(rows)), 0))
        tile = np.flatnonzero((np.arange(len(rows)) - start) % TILE == 0)
        pairs = []
        levels = []
        owner = rows[tile]
        for _ in range(max(wanted) + 1):
            fresh = np.r_[True, owner[1:] != owner[:-1]]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(owner)), 0))
            half = np.flatnonzero((np.arange(len(owner)) - first) % 2 == 0)
            levels.append((owner, half))
            owner = owner[half]
        for nth, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS)):
            lowest = np.minimum.reduceat(hashes * factor + shift, tile)
            for size, (owner, half) in enumerate(levels):
                if size in wanted:
                    window = lowest.copy()
                    both = owner[1:] == owner[:-1]
                    window[:-1][both] = np.minimum(lowest[:-1], lowest[1:])[both]
                    key = _key(window, size, nth)
                    maybe = np.flatnonzero(self.likely[(key >> np.uint64(48)).astype(np.int64)])
                    if len(maybe):
                        at, found = lookup(self.keys, key[maybe])
                        pairs.append(np.stack([owner[maybe[found]], at[found]]))
                lowest = np.minimum.reduceat(lowest, half)
        return np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)

    def search(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, int]]:
        """Row, item and number of shared shingles of all pairs that reach ``threshold``."""
        data, starts, ends, rows = word_spans(column, ALNUM)
        words = span_hash(data, starts, ends)
        by_size = {k: chain_hash(words, rows, k) for k in {SHINGLE, *self.sizes}}
        hashes, first = by_size[SHINGLE]
        wanted: set[tuple[int, int]] = set()
        row, place = self.candidates(hashes, rows[first])
        of_row, at_key = _owners(self.keys, place)
        wanted.update(zip(row[of_row].tolist(), self.owners[at_key].tolist()))
        for k, (keys, owners) in self.short.items():
            h, at = by_size[k]
            first, found = lookup(keys, h)
            of_hash, at_key = _owners(keys, first[found])
            wanted.update(zip(rows[at[found]][of_hash].tolist(), owners[at_key].tolist()))
        edges = np.searchsorted(rows, np.arange(len(column) + 1))
        of = {k: np.searchsorted(rows[at], np.arange(len(column) + 1)) for k, (_, at) in by_size.items()}
        held: tuple[int, int] | None = None
        own: set[bytes] = set()
        for r, item in sorted(wanted, key=lambda x: (x[0], self.sizes[x[1]])):
            k, need = self.sizes[item], threshold * len(self.shingles[item])
            here = by_size[k][0][of[k][r]: of[k][r + 1]]
            if np.isin(self.hashes[item], here).sum() < need:
                continue
            if held != (r, k):  # hashes agree; now the words themselves
                span = slice(edges[r], edges[r + 1])
                text = [data[a:b].tobytes() for a, b in zip(starts[span], ends[span])]
                own = {b" ".join(text[j: j + k]) for j in range(len(text) - k + 1)}
                held = (r, k)
            shared = len(self.shingles[item] & own)
            if shared >= need:
                yield r, item, shared


def item_blocks(items: DataFrame, words: int = BLOCK_WORDS) -> Iterator[Items]:
    """All items in blocks of about so many words; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += (row[1] or "").count(" ") + 1
        if size >= words:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of a document and an item of which it holds ``threshold`` of the shingles.

    ``doc_id``, ``item_id``, ``n_shingles`` (distinct ones of the item), ``n_shared`` and
    ``containment``.  Words are runs of ASCII letters, digits and anything beyond ASCII,
    A-Z lower-cased; shingles are five of them, or all where an item has fewer.  Items are
    the query set: they are broadcast in blocks of ``BLOCK_WORDS`` words, one pass over the
    documents for each.  Null and empty texts hold nothing, and items without a word are
    held by nothing; null ids and repeated rows on either side give rows of their own;
    empty tables give none.  Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    found = f"doc_id {kind}, item_id {item_kind}, n_shingles long, n_shared long, containment double"
    item_type = _arrow(items.schema["item_id"].dataType)
    context = docs.sparkSession.sparkContext
    parts = []
    for block in item_blocks(items):
        shared = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in blocks(batches):
                pairs = list(block.search(batch.column("text"), threshold))
                if pairs:
                    sizes = [len(block.shingles[i]) for _, i, _ in pairs]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").take(pa.array([r for r, _, _ in pairs])),
                        "item_id": pa.array([block.ids[i] for _, i, _ in pairs], item_type),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "n_shared": pa.array([s for _, _, s in pairs], pa.int64()),
                        "containment": pa.array([s / n for (_, _, s), n in zip(pairs, sizes)], pa.float64()),
                    })

        part = docs.select("doc_id", "text").mapInArrow(search, found)
        parts.append(stored(part, "leaks"))
        shared.unpersist()
    if not parts:
        return docs.sparkSession.createDataFrame([], found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold none of the items."""
    schema = docs.schema
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                leaks = {r for r, _, _ in shared.value.search(batch.column("text"), threshold)}
                yield batch.filter(pa.array([i not in leaks for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: The same pairs in DuckDB.
SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS row_no, doc_id AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), sizes AS (
  SELECT *, least(5, len(w)) AS k FROM words WHERE kind = 'i' AND len(w) > 0
), wanted AS (
  SELECT DISTINCT row_no, id, k, array_to_string(w[i : i + k - 1], ' ') AS shingle
  FROM sizes, unnest(range(1, len(w) - k + 2)) AS t(i)
), held AS (
  SELECT DISTINCT row_no, id, s.k, array_to_string(w[i : i + s.k - 1], ' ') AS shingle
  FROM words, (SELECT DISTINCT k FROM sizes) AS s, unnest(range(1, len(w) - s.k + 2)) AS t(i)
  WHERE kind = 'd'
), counts AS (SELECT row_no, count(*) AS n FROM wanted GROUP BY ALL)
SELECT held.id AS doc_id, wanted.id AS item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM held JOIN wanted USING (k, shingle) JOIN counts ON counts.row_no = wanted.row_no
GROUP BY held.row_no, held.id, wanted.row_no, wanted.id, n
HAVING count(*) >= 0.8 * n
"""
