"""Groups of texts whose word shingles have a Jaccard similarity over a bound, found without loss.

Fingerprints are linked first, by the index of ``simhash``; links that the shingles confirm
stay.  For the rest shingles are put in one order for all texts.  Two texts of which ``similarity`` of all
shingles are common have one in common among the first few of each (the prefix filter), so
texts meet by those, and every pair that meets is checked by its shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm import simhash
from memloom.llm.common import (PLAIN, aside, blocks, chain_hash, discard, lookup, mix, restored, span_hash, stored, sweep,
                                widened, word_spans)
from memloom.llm.components import components, merged

WORDS, SIMILARITY = 5, 0.8
#: Bits by which linked fingerprints may differ; what lies further apart meets by shingles.
DISTANCE = 4
#: Texts looked at for shingles that many texts share, and how many of those are told
#: apart.  Both only say what is put last in the order; any order gives the same groups.
SAMPLE_TEXTS, COMMON = 10_000, 1 << 20
#: Bits of a sketch; texts of up to about twice as many shingles are told apart by it.
SKETCH_BITS = 1024
#: Rows of one number each that are sent to every task, so that texts need no shuffle.
FEW = 2_000_000
#: Turns at most in which texts meet one text of each of their shingles, before all pairs left do; the
#: first that leaves over half of the rows is the last.
TURNS = 3


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """All runs of ``words`` words, A-Z lower-cased; the whole of a text that has fewer."""
    tokens = (text or "").encode().lower().split()
    return {b" ".join(tokens[i: i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def _hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every distinct shingle, by row."""
    data, starts, ends, rows = word_spans(column, PLAIN)
    own = span_hash(data, starts, ends)
    n = np.bincount(rows, minlength=len(column))[rows]
    found = [chain_hash(own, rows, words)]
    places = [rows[found[0][1]]]
    for k in range(1, words):  # shorter texts are one shingle each
        short = n == k
        h, first = chain_hash(own[short], rows[short], k)
        found.append((mix(h ^ np.uint64(k)), first))
        places.append(rows[short][first])
    hashes, rows = np.concatenate([h for h, _ in found]), np.concatenate(places)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])][: len(hashes)]
    return hashes[fresh], rows[fresh]


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``copy``, equal for texts with equal words, white space and case aside.

    It is half of a digest of 128 bits, and the other half where two texts share the first.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids = b"".join(blake2b(b" ".join((t or "").encode().lower().split()), digest_size=16).digest()
                           for t in batch.column("text").to_pylist())
            halves = np.frombuffer(ids, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                                             names=[*batch.schema.names, "copy", "more"])

    rows = stored(docs.mapInArrow(add, widened(docs.schema, copy="long", more="long")), "rows")
    clash = rows.groupBy("copy").agg(F.min("more").alias("a"), F.max("more").alias("b")).where("a <> b")
    clash = clash.select("copy", F.lit(True).alias("clash"))
    if clash.limit(1).count():
        told = stored(rows.join(clash, "copy", "left").withColumn("copy", F.when(F.col("clash"), F.col("more")).otherwise(F.col("copy")))
                      .select(*rows.columns), "rows")
        discard(rows)
        rows = told
    return rows.drop("more")


def common_shingles(rows: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that a sample of different texts shares, and in how many each is."""
    n = rows.agg(F.approx_count_distinct("copy")).first()[0]
    sample = rows.where(F.pmod("copy", F.lit(max(1, n // SAMPLE_TEXTS))) == 0).groupBy("copy").agg(F.first("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_pydict({"key": _hashes(batch.column("text"), words)[0].view(np.int64)})

    found = sample.select("text").mapInArrow(each, "key long").groupBy("key").count().where("count > 1")
    table = found.orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("count").to_numpy()[order]


def prefixes(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The first shingles of each text, rare ones before common ones: ``key``, its ``place``
    (from 0), ``copy`` and its number ``n`` of distinct shingles.  Copies within one block
    give one."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch in blocks(batches):
            _, once = np.unique(batch.column("copy").to_numpy(), return_index=True)
            batch = batch.take(pa.array(once))
            hashes, of = _hashes(batch.column("text"), words)
            at, found = lookup(known, hashes)
            often = np.zeros(len(hashes), np.int64)
            often[found] = times[at[found]]
            order = np.lexsort((hashes, often, of))
            hashes, of = hashes[order], of[order]
            n = np.bincount(of, minlength=batch.num_rows)
            place = np.arange(len(of)) - np.searchsorted(of, np.arange(batch.num_rows))[of]
            keep = place <= n[of] - np.ceil(similarity * n[of] - 1e-6)
            copy = batch.column("copy").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "key": hashes[keep].view(np.int64), "place": place[keep].astype(np.int32),
                "copy": copy[of[keep]], "n": n[of[keep]].astype(np.int32)})

    return rows.select("copy", "text").mapInArrow(each, "key long, place int, copy long, n int")


def meeting(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key another copy has, too, each once and with the ``least`` copy of
    its key, its place and number of shingles.

    Narrow rows are sorted by key and read in a stream; a text has many keys, so one key
    has a small share of them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = copy = None
        low = np.zeros((3, 1), np.int64)  # copy, place and number of the least copy of ``key``
        first: tuple | None = None  # the row of the least copy, until another one comes
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("key", "copy", "place", "n")]
            lead = [np.array([x], c.dtype) for x, c in zip(first or (0, 0, 0, 0), columns)] if first else None
            k, c, p, n = [np.r_[x, y] for x, y in zip(lead, columns)] if lead else columns
            begin = np.r_[True, k[1:] != k[:-1]]
            fresh = begin | np.r_[True, c[1:] != c[:-1]]  # repeated rows of one copy are left out
            if not lead and key is not None:
                begin[0], fresh[0] = k[0] != key, k[0] != key or c[0] != copy
            k, c, p, n, begin = k[fresh], c[fresh], p[fresh], n[fresh], begin[fresh]
            if not len(k):
                continue
            run = np.cumsum(begin)  # 0: goes on from the batch before
            starts = np.flatnonzero(begin)
            lows = np.concatenate([low, np.stack([c[starts], p[starts], n[starts]]).astype(np.int64)], axis=1)[:, run]
            size = np.bincount(run, minlength=len(starts) + 1)
            keep = (size[run] > 1) | (run == 0)
            first = (k[-1], c[-1], p[-1], n[-1]) if begin[-1] else None
            key, copy, low = k[-1], c[-1], lows[:, -1:]
            yield pa.RecordBatch.from_pydict({
                "key": k[keep], "copy": c[keep], "place": p[keep], "n": n[keep], "least": lows[0][keep],
                "least_place": lows[1][keep].astype(np.int32), "least_n": lows[2][keep].astype(np.int32)})

    return keys.repartition("key").sortWithinPartitions("key", "copy").select("key", "copy", "place", "n").mapInArrow(
        each, "key long, copy long, place int, n int, least long, least_place int, least_n int")


def _few(table: DataFrame) -> DataFrame:
    """A table of numbers, to be sent to every task if it has ``FEW`` rows or less."""
    return F.broadcast(table) if table.count() <= FEW else table


def verified(pairs: DataFrame, rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (``u``, ``v``) of copies whose texts have ``similarity`` or more, by their shingles themselves.

    Only texts of copies in ``pairs`` are read on; one of them is joined at a time, and what
    was written for that is deleted at the end.
    """
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("u").alias("copy")).union(pairs.select("v")).distinct()
    once = rows.groupBy("copy").agg(F.min("row_no").alias("row_no")).join(nodes, "copy", "left_semi")
    once = stored(once.select("row_no"), "once")
    texts = stored(rows.join(_few(once), "row_no", "left_semi").select("copy", "text"), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keep, last = [], None
            for u, one, other in zip(*(batch.column(c).to_pylist() for c in ("u", "text", "other"))):
                if u != last:  # pairs of one text come one after the other
                    last, held = u, shingles(one, words)
                other = shingles(other, words)
                both = len(held & other)
                keep.append(both / max(1, len(held) + len(other) - both) >= similarity)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sides = _few(pairs).join(texts.select(F.col("copy").alias("v"), F.col("text").alias("other")), "v").join(
        texts.withColumnRenamed("copy", "u"), "u")
    out = stored(sides.select("u", "v", "text", "other").mapInArrow(check, "u long, v long"), "verified")
    discard(pairs, once, texts)
    return out


def fingerprint_pairs(rows: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Pairs of copies whose SimHash fingerprints a Gray-ordered index links, or which have the same one."""
    codes = simhash.fingerprints(rows.select("copy", "text"), words).select("copy", "fingerprint").distinct()
    codes = stored(codes, "codes")
    least = codes.groupBy("fingerprint").agg(F.min("copy").alias("v"))
    same = codes.join(least, "fingerprint").where("copy <> v").select(F.col("copy").alias("u"), "v")
    edges = stored(simhash.near_edges(codes, distance), "near")
    ends = [least.select(F.col("fingerprint").alias(c), F.col("v").alias(f"{c}_copy")) for c in "uv"]
    near = edges.join(ends[0], "u").join(ends[1], "v").select(F.col("u_copy").alias("u"), F.col("v_copy").alias("v"))
    return same.union(near).distinct()


def _could(n: str, place: str, other_n: str, other_place: str, similarity: float) -> Column:
    """Whether two texts may reach ``similarity`` if their first common shingle has these places."""
    need = (F.col(n) + F.col(other_n)) * (similarity / (1 + similarity)) - 1e-6
    return F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place)) >= need


def similar_roots(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``node`` and ``root``: of each copy that has a link, the least copy that links of ``similarity`` or more lead to.

    First come the pairs that the fingerprint index links; they connect most near copies at a
    few links a text.  What it leaves apart meets by shingles: each text with one that its
    shingle has in common, which connects a group by as many links as it has texts; then all
    pairs that meet and are not connected yet.  A pair is checked only if its sizes and the
    places of the shingle allow enough common ones.  That holds where the shingle is their
    first common one, and there every pair meets; so no link is lost.  In the last step the
    pair's sketches must allow it, too, which parts texts that share no more than passages.
    """
    links = verified(fingerprint_pairs(rows, words), rows, words, similarity)
    first = stored(components(links), "roots")
    sweep(rows.sparkSession)
    met = stored(meeting(prefixes(rows, words, similarity)), "met")
    star = met.where(F.col("copy") != F.col("least")).where(_could("n", "place", "least_n", "least_place", similarity))
    star = _apart(star.select(F.col("least").alias("u"), F.col("copy").alias("v")).distinct(), first)
    links = verified(star, rows, words, similarity)
    root = merged(first, links)
    discard(first, links)
    sweep(rows.sparkSession)
    named = met.select("key", "copy", "place", "n").join(root, met["copy"] == root["node"], "left").select(
        "key", "place", "copy", "n", F.coalesce("root", "copy").alias("root"))
    left = _still_apart(named)
    discard(met)
    nodes = left.select("copy").distinct()
    wide = [F.element_at("sketch", i + 1).alias(f"w{i}") for i in range(SKETCH_BITS // 64)]
    drawn = stored(sketches(rows.join(_few(nodes), "copy", "left_semi"), words).select("copy", *wide), "sketches")
    links, waiting = [], left.count()
    for turn in range(TURNS):
        links.append(verified(one_for_each(left, drawn, turn, similarity), rows, words, similarity))
        if not links[-1].limit(1).count():
            break
        before, left = left, _regrouped(left, links[-1])
        discard(before)
        sweep(rows.sparkSession)
        rest = left.count()
        if not rest or 2 * rest > waiting:
            break
        waiting = rest
    plain, left = left, stored(left.join(drawn, "copy"), "met-drawn")
    discard(plain, drawn)
    links.append(verified(all_apart(left, similarity), rows, words, similarity))
    discard(left)
    sweep(rows.sparkSession)
    out = merged(root, functools.reduce(DataFrame.union, links))
    discard(root, *links)
    return out


def _still_apart(named: DataFrame) -> DataFrame:
    """Rows of ``named`` whose key has more than one ``root``, stored."""
    named = stored(named, "met-roots")
    apart = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = stored(named.join(apart, "key", "left_semi"), "met-apart")
    discard(named)
    return left


def _regrouped(left: DataFrame, links: DataFrame) -> DataFrame:
    """``left`` with the roots that ``links`` between its copies make one, where they are still apart."""
    of = left.select("copy", "root").distinct()
    ends = links.join(of.select(F.col("copy").alias("u"), F.col("root").alias("a")), "u").join(
        of.select(F.col("copy").alias("v"), F.col("root").alias("b")), "v")
    found = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("root", "to")
    out = _still_apart(left.join(found, left["root"] == found["node"], "left").select(
        "key", "place", "copy", "n", F.coalesce("to", "root").alias("root")))
    discard(found)
    return out


def one_for_each(left: DataFrame, drawn: DataFrame, turn: int, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``u``, ``v``: each row of ``left`` with a copy of the root that most rows of its key have.

    The copy is drawn for each key and ``turn``, so a text meets as many of a large group as
    they have shingles in common, and there are no more pairs than rows.
    """
    draw = F.min_by(F.struct("copy", "place", "n"), F.xxhash64("copy", "key", F.lit(turn)))
    groups = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("times"), draw.alias("one"))
    largest = groups.groupBy("key").agg(F.max_by(F.struct("root", "one"), F.struct("times", "root")).alias("to")).select(
        "key", F.col("to.root").alias("to_root"), F.col("to.one.copy").alias("to"),
        F.col("to.one.place").alias("to_place"), F.col("to.one.n").alias("to_n"))
    met = left.join(largest, "key").where((F.col("root") != F.col("to_root")) & _could("n", "place", "to_n", "to_place", similarity))
    pairs = met.select(F.greatest("copy", "to").alias("u"), F.least("copy", "to").alias("v"),
                       _alone("n", "to_n", similarity).alias("alone")).distinct()
    both = pairs.join(drawn.alias("a"), F.col("u") == F.col("a.copy")).join(drawn.alias("b"), F.col("v") == F.col("b.copy"))
    return both.where(_differing("a", "b") <= F.col("alone")).select("u", "v")


def all_apart(left: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs ``u``, ``v`` of copies in ``left`` that share a key and may reach ``similarity``."""
    a, b = left.alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.copy") > F.col("b.copy"))
                   & (F.col("a.root") != F.col("b.root")) & _could("a.n", "a.place", "b.n", "b.place", similarity)
                   & (_differing("a", "b") <= _alone("a.n", "b.n", similarity)))
    return pairs.select(F.col("a.copy").alias("u"), F.col("b.copy").alias("v")).distinct()


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``copy`` and a ``sketch`` of 64-bit words: bit i is the parity of the shingles that hash to i.

    Shingles that two texts share cancel out, so at least as many shingles are in one of them
    alone as their sketches differ in bits.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, of = _hashes(batch.column("text"), words)
            bit = of * SKETCH_BITS + (hashes >> np.uint64(32)).astype(np.int64) % SKETCH_BITS
            parity = (np.bincount(bit, minlength=batch.num_rows * SKETCH_BITS) % 2).astype(np.uint8)
            numbers = np.packbits(parity, bitorder="little").view(np.int64)
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * (SKETCH_BITS // 64)
            yield pa.RecordBatch.from_pydict({
                "copy": batch.column("copy"), "sketch": pa.ListArray.from_arrays(pa.array(bounds), pa.array(numbers))})

    return rows.select("copy", "text").mapInArrow(each, "copy long, sketch array<long>").dropDuplicates(["copy"])


def _alone(n: str, other_n: str, similarity: float) -> Column:
    """Shingles in one of two texts alone, at most, if they reach ``similarity``."""
    return (F.col(n) + F.col(other_n)) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    words = [F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(SKETCH_BITS // 64)]
    return functools.reduce(lambda x, y: x + y, words)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` that ``roots`` does not connect."""
    for c in "uv":
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    return pairs.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of ``docs``, with all its columns: the one of smallest id.

    A group is what a chain of texts leads to of which each two neighbours share
    ``similarity`` or more of their distinct shingles of ``words`` words.  Words are what white
    space parts, A-Z lower-cased; a text of fewer words is one shingle.  Null and empty texts and
    those of white space are copies of each other.  Rows without an id come after all others;
    between rows of one id (repeated rows) the first stored one stays.  Texts of any length
    are compared whole; columns may have any names; an empty table stays empty.

    Pairs that meet by one shingle, are not connected and could still be similar are all
    checked: many texts of one frame that all stay just under ``similarity`` cost their square.
    """
    numbered = docs.select("doc_id", "text", aside(docs), F.monotonically_increasing_id().alias("row_no"))
    rows = copies(numbered)
    roots = similar_roots(rows, words, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no")
    first = rows.groupBy("copy").agg(F.min(place).alias("first"))
    first = first.join(roots, first["copy"] == roots["node"], "left").select(
        F.coalesce("root", "copy").alias("root"), "first")
    kept = first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_no").alias("row_no"))
    gone = stored(rows.select("row_no").join(kept, "row_no", "left_anti"), "gone")
    discard(roots)
    return rows.join(_few(gone), "row_no", "left_anti").select(*restored(docs.columns))
