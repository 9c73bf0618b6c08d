"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

The letters fall into groups.  One edit changes the count of at most two groups, one up and
one down, so words one edit apart meet in a trie of their counts by paths that spend a
surplus and a deficit of one at most.  The first levels of the trie deal the words over
tasks; the levels below are walked inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import LOWER, blocks, coded_words, stored, text_bytes

#: Letters are grouped by their code point modulo this.
GROUPS = 16
#: Groups of the first levels, which deal the words: those whose counts tell most apart.
TOP = (5, 1, 14, 9, 3, 2)
#: Groups of the levels below.
BELOW = tuple(g for g in range(GROUPS) if g not in TOP)
#: Words of one node of the first levels before it is split, and pairs that are verified at once.
CHUNK, PAIRS = 8192, 1 << 20
#: Counts from here on are one; neighbours stay neighbours.
MOST = 1023
#: One run in so many loses a code point.
DAMAGE = 199


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF, whose first byte is C3."""
    inside = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def word_counts(docs: DataFrame, least_letters: int = 6, least_times: int = 5) -> DataFrame:
    """``word`` and its occurrences ``n`` in all texts, for words of enough code points that occur often enough.

    A run whose CRC-32 with the id of its document 199 divides loses one code point first;
    where the id is null none does.  Occurrences are added up within a block of text before
    the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column("text"))
            inside = _letters(data)
            words, code, row = coded_words(LOWER[data], inside, offsets)
            if not len(code):
                continue
            pair, times = np.unique(row * len(words) + code, return_counts=True)
            row, code = pair // len(words), pair % len(words)
            known = [w.encode() for w in words.to_pylist()]
            starts = [None if i is None else crc32(b"%d:" % i) for i in batch.column("doc_id").to_pylist()]
            hashes = [1 if starts[r] is None else crc32(known[c], starts[r]) for r, c in zip(row.tolist(), code.tolist())]
            hit = np.array(hashes, np.int64) % DAMAGE == 0
            changed = []
            for i in np.flatnonzero(hit).tolist():
                w = known[code[i]].decode()
                at = hashes[i] % len(w)
                changed.append(w[:at] + w[at + 1:])
            n = np.bincount(code[~hit], times[~hit], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "word": pa.concat_arrays([words.cast(pa.string()), pa.array(changed, pa.string())]),
                "n": np.r_[n, times[hit]].astype(np.int64)})

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    found = found.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_times)


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ``words``, one after the other, and their n + 1 bounds."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return letters, np.r_[0, np.cumsum(sizes)]


def frequencies(words: pa.Array) -> np.ndarray:
    """Counts of the letter groups of each word."""
    letters, bounds = _flat(words)
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    counts = np.bincount(row * GROUPS + letters % GROUPS, minlength=len(words) * GROUPS)
    return np.minimum(counts.reshape(len(words), GROUPS), MOST)


def _moves() -> np.ndarray:
    """Changes of the counts of the first levels within the budget, none or upward first, so that
    of two nodes one visits the other."""
    every = [m for m in product((-1, 0, 1), repeat=len(TOP)) if m.count(1) <= 1 and m.count(-1) <= 1]
    return np.array([m for m in every if next((x for x in m if x), 1) > 0], np.int64)


def _key(counts: np.ndarray) -> np.ndarray:
    return counts @ (np.int64(MOST + 1) ** np.arange(len(TOP), dtype=np.int64))


def dealt(words: DataFrame) -> DataFrame:
    """Words at their node of the first levels (``visit`` 0) and as visitors of all nodes in reach
    (``visit`` 1, with the budget ``up`` and ``down`` left), by ``node`` and ``chunk``.

    A node of more than ``CHUNK`` words is split; its visitors go to every chunk.
    """
    moves = _moves()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                counts = frequencies(part.column("word"))[:, list(TOP)]
                there = counts[:, None] + moves
                word, move = np.nonzero(((there >= 0) & (there <= MOST)).all(axis=2))
                yield pa.RecordBatch.from_pydict({
                    "node": _key(there[word, move]), "word": part.column("word").take(pa.array(word)),
                    "n": part.column("n").take(pa.array(word)),
                    "up": (1 - (moves == 1).sum(axis=1))[move].astype(np.int8),
                    "down": (1 - (moves == -1).sum(axis=1))[move].astype(np.int8)})

    guests = words.mapInArrow(visits, "node long, word string, n long, up byte, down byte")
    # a word's visit of its own node has spent nothing, and is its place there, too
    homes = guests.where("up = 1 AND down = 1").select("node", "word", "n")
    large = homes.groupBy("node").count().where(F.col("count") > CHUNK).select(
        "node", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    homes = homes.join(large, "node", "left").select(
        "node", F.pmod(F.xxhash64("word"), chunks).cast("int").alias("chunk"), F.lit(0).cast("byte").alias("visit"),
        "word", "n", F.lit(1).cast("byte").alias("up"), F.lit(1).cast("byte").alias("down"))
    guests = guests.join(large, "node", "left").select(
        "node", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).cast("byte").alias("visit"),
        "word", "n", "up", "down")
    return homes.union(guests)


class Trie:
    """The levels below of some words: each level has the distinct counts below every node."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        counts = frequencies(words)[:, list(BELOW)]
        order = np.lexsort(counts.T[::-1])
        self.words, self.n = words.take(pa.array(order)), n[order]
        counts = counts[order]
        self.levels = []
        node = np.zeros(len(words), np.int64)
        for column in counts.T:
            edge = node * (MOST + 1) + column
            fresh = np.r_[True, edge[1:] != edge[:-1]][: len(edge)]
            self.levels.append(edge[fresh])
            node = np.cumsum(fresh) - 1
        self.bounds = np.searchsorted(node, np.arange(node[-1] + 2)) if len(node) else np.zeros(1, np.int64)
        self.letters, self.at = _flat(self.words)

    def leaves(self, counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Visitors (rows of ``counts``) and leaves within their budget, level by level."""
        who, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        for level, edges in enumerate(self.levels):
            parts = []
            for change in (0, 1, -1):
                can = slice(None) if not change else np.flatnonzero((up if change > 0 else down) > 0)
                value = counts[who[can], level] + change
                edge = node[can] * (MOST + 1) + value
                place = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
                there = (edges[place] == edge) & (value >= 0) & (value <= MOST)
                parts.append((who[can][there], place[there], up[can][there] - (change > 0), down[can][there] - (change < 0)))
            who, node, up, down = (np.concatenate(x) for x in zip(*parts))
        return who, node

    def near(self, words: pa.Array, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a visitor and a word here that one edit makes of it."""
        if not len(self.words):
            return
        letters, at = _flat(words)
        who, leaf = self.leaves(frequencies(words)[:, list(BELOW)], up, down)
        sizes = self.bounds[leaf + 1] - self.bounds[leaf]
        ends = np.cumsum(sizes)
        first = 0
        while first < len(who):  # a bounded number of pairs at once; a leaf is never one large group of pairs
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            n = sizes[first:last]
            of = np.repeat(np.arange(len(n)), n)
            mine = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.bounds[leaf[first:last]][of]
            yours = who[first:last][of]
            good = one_edit(letters, at[yours], at[yours + 1], self.letters, self.at[mine], self.at[mine + 1])
            yield yours[good], mine[good]
            first = last


def one_edit(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Places of the pairs of spans that differ by exactly one inserted, deleted or replaced code point."""
    long, short = np.maximum(a_to - a_from, b_to - b_from), np.minimum(a_to - a_from, b_to - b_from)
    left = np.flatnonzero(long - short <= 1)
    common = np.zeros(len(long), np.int64)
    for sign, x, y in ((1, a_from, b_from), (-1, a_to - 1, b_to - 1)):
        open_, step = left, 0
        same = np.zeros(len(long), np.int64)
        while len(open_):
            open_ = open_[short[open_] > step]
            open_ = open_[a[x[open_] + sign * step] == b[y[open_] + sign * step]]
            same[open_] += 1
            step += 1
        common += same
        if sign > 0:
            left = left[same[left] < long[left]]  # equal words are no variants
    return left[common[left] >= long[left] - 1]


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (distinct ``word``, with ``n``) one code point apart, each once: ``a``, ``a_n``, ``b``, ``b_n``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        trie, place = None, None
        for batch in batches:
            node, chunk, visit = (batch.column(c).to_numpy() for c in ("node", "chunk", "visit"))
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (chunk[1:] != chunk[:-1]) | (visit[1:] != visit[:-1])) + 1
            for first, last in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(node)].tolist()):
                if first == last:
                    continue
                here = (node[first], chunk[first])
                if here != place:
                    held, trie, place = [], None, here
                part = batch.slice(first, last - first)
                words, n = part.column("word"), part.column("n").to_numpy()
                if visit[first] == 0:
                    held.append((words, n))
                    continue
                if trie is None:
                    trie = Trie(pa.concat_arrays([w for w, _ in held] or [pa.array([], pa.string())]),
                                np.concatenate([m for _, m in held] or [np.zeros(0, np.int64)]))
                up, down = part.column("up").to_numpy().astype(np.int64), part.column("down").to_numpy().astype(np.int64)
                for a, b in trie.near(words, up, down):
                    left, right = words.take(pa.array(a)), trie.words.take(pa.array(b))
                    # within one node each pair is met from both sides
                    once = pc.or_(pa.array((up[a] + down[a]) < 2), pc.less(left, right)) if len(a) else pa.array([], pa.bool_())
                    yield pa.RecordBatch.from_pydict({"a": left, "a_n": n[a], "b": right, "b_n": trie.n[b]}).filter(once)

    rows = dealt(words).repartition("node", "chunk").sortWithinPartitions("node", "chunk", "visit")
    return rows.mapInArrow(walk, "a string, a_n long, b string, b_n long")


def variant_groups(docs: DataFrame, least_letters: int = 6, least_times: int = 5, ratio: int = 5) -> DataFrame:
    """The words of ``docs`` with the more frequent word each is a variant of.

    ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``: the form is the near word of
    largest ``n``, the smallest of equal ones, if it occurs ``ratio`` times as often or more;
    the root is what the forms lead to, the word itself where it has none.  Null and empty
    texts hold no words; repeated rows count again; an empty table gives none; only ``doc_id``
    and ``text`` are read.
    """
    words = stored(word_counts(docs, least_letters, least_times), "words")
    pairs = near_words(words)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))).alias("s")).select("s.*")
    first = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    much = -F.col("first.m") >= ratio * F.col("n")
    named = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("first.near")).alias("form"), F.when(much, -F.col("first.m")).alias("form_n")), "forms")
    roots = follow(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """``word`` and the ``root`` its chain of links ends at; each round doubles the length that is known.

    A form occurs a number of times as often as its word, so chains are short and end.
    """
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = links.where("moved").limit(1).count()
        links = links.drop("moved")
        if not moved:
            return links
