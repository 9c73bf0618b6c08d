"""Exact search for the largest inner products, by MaxScore over the components as terms.

Each component is a term; its postings in a shard are the vectors in which it has the sign
it has in the query, and the largest product bounds what it adds.  The terms of smallest
bounds that together stay under the score to reach are not essential: a vector in no
posting of another term cannot get there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import best, stored

#: Vectors of a shard, and bytes of its components.
SHARD, SHARD_BYTES = 4096, 8 << 20
#: Bytes of the queries of one pass over the shards.
BLOCK_BYTES = 16 << 20
#: Terms that are not essential, looked up at once before bounds are held against the score to reach.
PROBE = 8


def integers(embedding: str | Column) -> Column:
    """floor(256 * x) of each component; null where the vector or a component is null or not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(e, lambda x: F.floor(x.cast("double") * 256)))


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``components`` and a number for each row of ``vectors`` that takes part, stored."""
    rows = vectors.select("vec_id", integers("embedding").alias("components"), F.monotonically_increasing_id().alias("row_no"))
    return stored(rows.where("components IS NOT NULL"), "vectors")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Shards of vectors that have the same number of components, as a matrix of integers."""
    for batch in batches:
        sizes = batch.column("components").value_lengths().to_numpy()
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            step = int(max(1, min(SHARD, SHARD_BYTES // (8 * max(1, n)))))
            for first in range(0, len(rows), step):
                part = batch.take(pa.array(rows[first: first + step]))
                yield part, part.column("components").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, n)


@dataclass
class Shard:
    """Components of some vectors, and for each sign of each the postings and the largest size."""

    values: np.ndarray
    postings: dict[int, list[np.ndarray]]
    largest: dict[int, np.ndarray]

    @staticmethod
    def of(values: np.ndarray) -> Shard:
        postings = {s: [np.flatnonzero(s * column > 0) for column in values.T] for s in (1, -1)}
        return Shard(values, postings, {s: (s * values).max(axis=0, initial=0) for s in (1, -1)})

    def find(self, query: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors that reach ``floor`` (None: of all)."""
        bound = np.abs(query) * np.where(query > 0, self.largest[1], self.largest[-1])
        if floor is None or floor <= 0:  # a vector in no posting may reach it, too
            score = self.values @ query
            at = np.arange(len(score)) if floor is None else np.flatnonzero(score >= floor)
            return at, score[at]
        order = np.argsort(bound, kind="stable")
        rest = np.cumsum(bound[order])
        free = int(np.searchsorted(rest, floor, "left"))  # these together stay under the floor
        essential, others = order[free:], order[:free][::-1]
        if not len(essential):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        upper = np.full(len(self.values), rest[free - 1] if free else 0)
        for d in essential:
            sign = 1 if query[d] > 0 else -1
            at = self.postings[sign][d]
            upper[at] += query[d] * self.values[at, d]
        # whatever stands in no essential posting has the bound of the others alone, under the floor
        at = np.flatnonzero(upper >= floor)
        score = self.values[np.ix_(at, essential)] @ query[essential]
        left = int(rest[free - 1]) if free else 0
        for first in range(0, free, PROBE):
            keep = score + left >= floor
            at, score = at[keep], score[keep]
            if not len(at):
                return at, score
            terms = others[first: first + PROBE]
            score = score + self.values[np.ix_(at, terms)] @ query[terms]
            left -= int(bound[terms].sum())
        keep = score >= floor
        return at[keep], score[keep]


@dataclass
class Queries:
    row_no: np.ndarray
    ids: pa.Array
    vectors: list[np.ndarray]


def query_blocks(queries: DataFrame) -> Iterator[Queries]:
    """All queries in blocks of bounded size; the driver holds one block at a time."""
    kind = queries.limit(0).select("vec_id").toArrow().schema.field(0).type
    rows, size = [], 0

    def block() -> Queries:
        return Queries(np.array([r[0] for r in rows], np.int64), pa.array([r[1] for r in rows], kind),
                       [np.array(r[2], np.int64) for r in rows])

    for row in queries.select("row_no", "vec_id", "components").toLocalIterator():
        rows.append(row)
        size += 8 * len(row[2]) + 64
        if size >= BLOCK_BYTES:
            yield block()
            rows, size = [], 0
    if rows:
        yield block()


def _merge(have: tuple, new: tuple, k: int) -> tuple:
    """The ``k`` best of two sets of rows (score, null, id): largest score, then smallest id."""
    score, null, ids = (np.r_[a, b] for a, b in zip(have, new))
    order = np.lexsort((ids, null, -score))[:k]
    return score[order], null[order], ids[order]


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each of ``queries``.

    Both come from ``quantised``, which gives each row its ``row_no``; ``queries`` are some of
    its rows, and a row is no candidate of its own.  The result has ``query_id``, ``rank``,
    ``vec_id`` and ``score``, ties by ascending ``vec_id``, null ids last.  Every task reads
    its shards one by one and keeps the best of each query, so the score to reach rises;
    what the tasks found is merged.  Queries come in blocks of ``BLOCK_BYTES``, broadcast one
    by one, each a pass over all shards.  Repeated rows are rows of their own, vectors of
    another number of components have no product with a query, an empty table gives no rows.
    Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_no long, query_id {kind}, vec_id {kind}, score long"
    out = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    for block in query_blocks(queries):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            found: list[tuple] = [(np.zeros(0, np.int64),) * 3] * len(block.vectors)
            kind = block.ids.type
            for batch, values in _matrices(batches):
                shard = Shard.of(values)
                ids = batch.column("vec_id")
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy().astype(np.int64)
                numbers = batch.column("row_no").to_numpy()
                for q, vector in enumerate(block.vectors):
                    if len(vector) != values.shape[1]:
                        continue
                    have = found[q]
                    at, score = shard.find(vector, int(have[0][-1]) if len(have[0]) == k else None)
                    own = numbers[at] != block.row_no[q]
                    at, score = at[own], score[own]
                    if len(at):
                        found[q] = _merge(have, (score, null[at], ids[at]), k)
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            if len(of):
                score, null, ids = (np.concatenate([f[i] for f in found]) for i in range(3))
                yield pa.RecordBatch.from_pydict({
                    "query_no": block.row_no[of], "query_id": block.ids.take(pa.array(of)),
                    "vec_id": pa.array(ids, mask=null.astype(bool)).cast(kind), "score": score})

        found = vectors.select("row_no", "vec_id", "components").mapInArrow(search, schema)
        order = [F.desc("score"), F.asc_nulls_last("vec_id")]
        out = out.unionByName(stored(best(found, "query_no", order, k), "products"))
        shared.unpersist()
    return out.select("query_id", "rank", "vec_id", "score")


#: The same for queries whose id 50 divides, in DuckDB.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM (
    SELECT q.row_no AS query_no, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
    FROM v AS q JOIN v ON q.row_no <> v.row_no WHERE q.vec_id % 50 = 0))
WHERE rank <= 5
"""
