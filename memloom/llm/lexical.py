"""Ranked lexical search: an index of strata, which hold the documents of one length normaliser.

A document counts by its terms and by its normaliser ``m`` alone, so all documents of one
``m`` stand together, and the postings of each term in a stratum are sorted by tf.  What a
term adds to a score is worked out once for each tf there, and its last tf bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import ALNUM, LOWER, best, blocks, coded_words, spans, stored, text_bytes, widened

#: Items of one pass over the index, and their words.
BLOCK_ITEMS, BLOCK_WORDS = 4096, 2_000_000
#: Strata of which the bounds are known before the first of them is visited.
VISIT = 64
#: Cells of items by documents, and postings, that are added up at once.
CELLS = 1 << 21

_SCALE = 1_000_000_000


@dataclass(frozen=True)
class Index:
    """``strata`` has one row for each part of a stratum: its ``m`` and ``docs``, its ``terms``
    with the number of their runs (``term_runs``), and for each run of one tf its ``tfs``, its
    documents (``run_docs``) and, one after the other, their places in ``docs`` (``slots``)."""

    strata: DataFrame
    n_docs: int
    n_terms: int


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the number ``n`` of terms of each text; rows without a term are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column("text"))
            n = np.bincount(spans(ALNUM[data], offsets)[2], minlength=batch.num_rows).astype(np.int64)
            counted = pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "n"])
            yield counted.filter(pa.array(n > 0))

    return docs.mapInArrow(count, widened(docs.schema, n="long"))


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    return coded_words(data, ALNUM[data], offsets)


def _lists(values: pa.Array | np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """``n`` lists of ``values``, of which each belongs to list ``of`` (ascending)."""
    bounds = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values).cast(kind))


def _strata(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The strata of some documents that come sorted by ``m``."""
    m = batch.column("m").to_numpy()
    words, term, row = _terms(batch.column("text"))
    fresh = np.r_[True, m[1:] != m[:-1]]
    stratum = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    pair, tf = np.unique(row * max(1, len(words)) + term, return_counts=True)
    row, term = pair // max(1, len(words)), pair % max(1, len(words))
    order = np.lexsort((row, tf, term, stratum[row]))
    row, term, tf = row[order], term[order], tf[order]
    of = stratum[row]
    new_term = np.r_[True, (of[1:] != of[:-1]) | (term[1:] != term[:-1])][: len(of)]
    new_run = np.r_[True, new_term[1:] | (tf[1:] != tf[:-1])][: len(of)]
    terms, runs = np.flatnonzero(new_term), np.flatnonzero(new_run)
    n = len(first)
    return pa.RecordBatch.from_pydict({
        "m": pa.array(m[first]),
        "docs": _lists(batch.column("doc_id"), stratum, n, batch.schema.field("doc_id").type),
        "terms": _lists(words.take(pa.array(term[terms])), of[terms], n, pa.string()),
        "term_runs": _lists(np.diff(np.r_[np.searchsorted(runs, terms), len(runs)]), of[terms], n, pa.int32()),
        "tfs": _lists(tf[runs], of[runs], n, pa.int32()),
        "run_docs": _lists(np.diff(np.r_[runs, len(of)]), of[runs], n, pa.int32()),
        "slots": _lists(row - first[of], of, n, pa.int32()),
    })


def build_index(docs: DataFrame) -> Index:
    """The index of all ``docs`` that hold a term; only ``doc_id`` and ``text`` are read.

    Documents are dealt by ``m`` with a rebalancing shuffle, which splits a stratum that
    holds a large share of them; a part of a stratum is a row of its own, with all its
    postings, of about 2 MB of text.  Null texts and those without a term are left out,
    null ids and repeated rows stay as they are, an empty table gives an empty index.
    """
    n_docs, n_terms = _counted(docs.select("text")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"75 + cast(25 * n as decimal(19,0)) * cast({n_docs} as decimal(19,0)) div cast({max(1, n_terms)} as decimal(20,0))")
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = _counted(docs.select("doc_id", "text")).select("doc_id", "text", m.cast("long").alias("m")).hint("rebalance", "m").sortWithinPartitions("m")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield _strata(batch)

    strata = dealt.mapInArrow(build, f"m long, docs array<{kind}>, terms array<string>, term_runs array<int>, "
                                     "tfs array<int>, run_docs array<int>, slots array<int>")
    return Index(stored(strata, "strata"), n_docs, n_terms)


@dataclass
class Items:
    """A block of items: their ids, distinct ``terms``, and how often (``times``) each ``item`` holds a ``term``."""

    ids: pa.Array
    terms: pa.Array
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str | None], kind: pa.DataType) -> Items:
        words, term, row = _terms(pa.array(texts, pa.string()))
        pair, times = np.unique(row * max(1, len(words)) + term, return_counts=True)
        return Items(pa.array(ids, kind), words.cast(pa.string()), pair // max(1, len(words)), pair % max(1, len(words)), times)


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """All items in blocks of bounded size; the driver holds one block at a time."""
    kind = items.limit(0).select("item_id").toArrow().schema.field(0).type
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += (row[1] or "").count(" ") + 1
        if size >= BLOCK_WORDS or len(ids) == BLOCK_ITEMS:
            yield Items.of(ids, texts, kind)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts, kind)


def _list(batch: pa.RecordBatch, name: str, i: int) -> pa.Array:
    return batch.column(name).slice(i, 1).flatten()


def document_counts(index: Index, items: Items) -> np.ndarray:
    """Documents that hold each of the terms of ``items``."""
    shared = index.strata.sparkSession.sparkContext.broadcast(items.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = pc.index_in(_list(batch, "terms", i), value_set=shared.value)
                known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                ends = np.cumsum(_list(batch, "term_runs", i).to_numpy())
                docs = np.r_[0, np.cumsum(_list(batch, "run_docs", i).to_numpy())][np.r_[0, ends]]
                total[at.take(pa.array(known)).to_numpy()] += np.diff(docs)[known]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": held, "n": total[held]})

    found = index.strata.select("terms", "term_runs", "run_docs").mapInArrow(count, "term long, n long")
    found = found.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each term of the block
    out = np.zeros(len(items.terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    shared.unpersist()
    return out


class Ranking:
    """The ``k`` best documents of each item so far, and the score to reach."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item, self.score, self.doc, self.null = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.ones(n, np.int64)  # scores are above 0

    def add(self, *new: np.ndarray) -> None:
        """More rows: item, score, document, and whether its id is null."""
        item, score, doc, null = (np.r_[a, b] for a, b in zip((self.item, self.score, self.doc, self.null), new))
        order = np.lexsort((doc, null, -score, item))
        nth = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]
        full = nth == self.k - 1
        self.floor[self.item[full]] = self.score[full]


class Visit:
    """One stratum and the terms that some item has in it."""

    def __init__(self, batch: pa.RecordBatch, i: int, items: Items, weight: np.ndarray):
        self.docs = _list(batch, "docs", i)
        m = batch.column("m")[i].as_py()
        at = pc.index_in(_list(batch, "terms", i), value_set=items.terms)
        known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        runs = np.r_[0, np.cumsum(_list(batch, "term_runs", i).to_numpy())]
        tfs = _list(batch, "tfs", i).to_numpy().astype(np.int64)
        self.impact = (_SCALE * tfs) // (1000 * tfs + 12 * m)
        self.run_docs = _list(batch, "run_docs", i).to_numpy()
        ends = np.r_[0, np.cumsum(self.run_docs)]
        self.slots = _list(batch, "slots", i)
        here = np.full(len(items.terms), -1, np.int64)
        here[at.take(pa.array(known)).to_numpy()] = known
        place = here[items.term]
        pairs = np.flatnonzero(place >= 0)
        place = place[pairs]
        self.item, self.weight = items.item[pairs], weight[pairs]
        self.first, self.last = ends[runs[place]], ends[runs[place + 1]]
        #: no document here scores more; impacts rise with tf, and runs are sorted by it
        self.bound = np.zeros(len(items.ids), np.int64)
        np.add.at(self.bound, self.item, self.weight * self.impact[runs[place + 1] - 1])

    def scores(self, ranking: Ranking) -> None:
        """Add up the postings of all items that may still rise here."""
        pairs = np.flatnonzero((self.bound >= ranking.floor)[self.item])
        if not len(pairs):
            return
        slots, impact = self.slots.to_numpy(), np.repeat(self.impact, self.run_docs)
        null = self.docs.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(self.docs, 0).to_numpy().astype(np.int64)
        item, size = self.item[pairs], (self.last - self.first)[pairs]
        wide = len(ids)
        # pairs come by item; an item over the bound is a part of its own
        begins = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        cost = np.cumsum(np.maximum(np.add.reduceat(size, begins), wide))
        begins = np.r_[begins, len(pairs)]
        a = 0
        while a < len(cost):
            b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CELLS, "right")))
            part = slice(begins[a], begins[b])
            local = np.searchsorted(item[begins[a:b]], item[part])
            n = size[part]
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[pairs[part]][of]
            cell, value = local[of] * wide + slots[at], self.weight[pairs[part]][of] * impact[at]
            if self.bound.max() < 1 << 52:  # doubles add up exactly
                total = np.bincount(cell, value, (b - a) * wide).astype(np.int64)
            else:
                total = np.zeros((b - a) * wide, np.int64)
                np.add.at(total, cell, value)
            total = total.reshape(b - a, wide)
            numbers = item[begins[a:b]]
            need = ranking.floor[numbers]
            if wide > ranking.k:
                need = np.maximum(need, np.partition(total, wide - ranking.k, axis=1)[:, wide - ranking.k])
            rows, columns = np.nonzero(total >= need[:, None])
            if len(rows):
                ranking.add(numbers[rows], total[rows, columns], ids[columns], null[columns])
            a = b


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Items come in blocks of at most ``BLOCK_ITEMS`` and about ``BLOCK_WORDS`` words, which are
    broadcast; a block is one pass over the index.  Each task visits its strata in descending
    order of their bounds, ``VISIT`` at a time, and leaves out, item by item, those whose bound
    is under the item's k-th score; what tasks found is merged.  Items without a known term,
    null texts and an empty index give no rows; equal scores come by ascending ``doc_id``, null
    ids last; repeated rows of either side are rows of their own.
    """
    spark = index.strata.sparkSession
    item_kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = index.strata.schema["docs"].dataType.elementType.simpleString()
    schema = f"item_no long, item_id {item_kind}, doc_id {doc_kind}, score long"
    out = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    for number, block in enumerate(item_blocks(items)):
        df = document_counts(index, block)
        weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((block, weight[block.term] * block.times))

        def visit(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            items, weight = shared.value
            ranking, kind = Ranking(len(items.ids), k), None
            for batch in batches:
                kind = batch.schema.field("docs").type.value_type
                for first in range(0, batch.num_rows, VISIT):
                    part = range(first, min(first + VISIT, batch.num_rows))
                    visits = [Visit(batch, i, items, weight) for i in part]
                    for one in sorted(visits, key=lambda v: -int(v.bound.max(initial=0))):
                        one.scores(ranking)
            if len(ranking.item):
                docs = pa.array(ranking.doc, mask=ranking.null.astype(bool)).cast(kind)
                yield pa.RecordBatch.from_pydict({
                    "item_no": ranking.item + number * BLOCK_ITEMS, "item_id": items.ids.take(pa.array(ranking.item)),
                    "doc_id": docs, "score": ranking.score})

        found = index.strata.mapInArrow(visit, schema)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        out = out.unionByName(stored(best(found, "item_no", order, k), "ranked"))
        shared.unpersist()
    return out.select("item_id", "rank", "doc_id", "score")


#: The same ranking in DuckDB.
SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS doc_no, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (
  SELECT count(*) AS total, sum(len(w)) AS terms FROM numbered WHERE len(w) > 0
), postings AS (
  SELECT doc_no, doc_id, len(w) AS n, term, count(*) AS tf
  FROM numbered, unnest(w) AS t(term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM postings, sizes GROUP BY term, total
), wanted AS (
  SELECT item_no, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item_no, item_id,
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark), unnest(w) AS t(term)
  GROUP BY ALL
), scored AS (
  SELECT item_no, item_id, doc_no, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // terms)))) AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY item_no, item_id, doc_no, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
