"""Documents packed into token windows by multiway differencing."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import blocks, stored

#: Tokens of the pieces that a document's last, incomplete window is cut into.
PIECE_TOKENS = 512
#: Windows that one differencing run fills; a run is one group of pieces.
GROUP_WINDOWS = 256
#: Neighbouring pieces of fewer tokens than this are divided as one, of up to twice as many:
#: so a group has a bounded number of parts to divide, also where every text is a word.
SMALL_TOKENS = 64

#: Texts of these characters alone, without a special token, are split alike by both libraries.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ–—‘-„€]*")


@functools.lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str | None, pattern: str | None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    fast = None
    if ranks:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        fast = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                 mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})
    return tokenizer, special, fast


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file, and optionally the same vocabulary as ranks with its split pattern.

    With ``ranks`` the ids come from the faster library wherever both must agree: texts of
    common Latin characters without a special token.  All others go through ``file``.
    """

    file: str
    ranks: str | None = None
    pattern: str | None = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        tokenizer, special, fast = _encoders(self.file, self.ranks, self.pattern)
        plain = [fast is not None and _PLAIN.fullmatch(t) is not None and not any(s in t for s in special)
                 for t in texts]
        rest = iter(tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p],
                                                add_special_tokens=False))
        return [fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]


@dataclass(frozen=True)
class Packed:
    """``pieces``: doc_id, piece, start, ids (little-endian uint32), length, doc_tokens;
    ``plan``: piece, sequence_id, offset for each of them."""

    pieces: DataFrame
    plan: DataFrame

    def sequences(self, length: int, pad: int = 0) -> DataFrame:
        """The windows themselves: sequence_id, ids padded to ``length``."""
        def join(group: pd.DataFrame) -> pd.DataFrame:
            ids = np.full(length, pad, "<u4")
            for offset, part in zip(group["offset"], group["ids"]):
                part = np.frombuffer(part, "<u4")
                ids[offset: offset + len(part)] = part
            return pd.DataFrame({"sequence_id": group["sequence_id"].iloc[:1], "ids": [ids.tolist()]})

        both = self.pieces.select("piece", "ids").join(self.plan, "piece")
        return both.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>")


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = 2048, end_id: int = 1,
         piece_tokens: int = PIECE_TOKENS, group_windows: int = GROUP_WINDOWS) -> Packed:
    """Pack every token of every document into windows of at most ``window`` tokens.

    A document is its ids and ``end_id``.  Whole windows are cut off first and stand alone;
    what is left is cut into pieces of ``piece_tokens``, and small neighbours are taken
    together (``bundles``).  These are dealt by number to groups of about ``group_windows`` windows, and each group is divided by multiway
    differencing (``difference``), which gives nearly equal windows; a group whose fullest
    window is over capacity is divided again into one window more.  The number of groups
    follows the number of tokens, so a task's work is bounded at any size.

    Null text counts as empty: one piece with ``end_id``.  Repeated rows and null ids are
    packed like any other row; an empty table gives no pieces.  Only ``doc_id`` and
    ``text`` are read.
    """
    if not 0 < piece_tokens <= window:
        raise ValueError("pieces must fit a window")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            row, start, ids, whole = [], [], [], []
            for i, tokens in enumerate(vocabulary.encode([t or "" for t in batch.column("text").to_pylist()])):
                tokens = np.array([*tokens, end_id], "<u4")
                full = len(tokens) // window * window
                edges = [*range(0, full, window), *range(full, len(tokens), piece_tokens), len(tokens)]
                for a, b in zip(edges, edges[1:]):
                    row.append(i)
                    start.append(a)
                    ids.append(tokens[a:b].tobytes())
                    whole.append(len(tokens))
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(row), "start": pa.array(start, pa.int64()),
                "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(whole, pa.int64()),
                "back": bundles(np.array([len(x) // 4 for x in ids], np.int64), min(SMALL_TOKENS, piece_tokens // 2)),
            })

    pieces = docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start long, ids binary, doc_tokens long, back long"
    ).withColumns({"piece": F.monotonically_increasing_id(),
                   "length": (F.length("ids") / 4).cast("long")})
    pieces = stored(pieces.withColumn("bundle", F.col("piece") - F.col("back")).drop("back"), "pieces")

    alone = pieces.where(F.col("length") == window).select(
        "piece", (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window).select("piece", "length", "bundle")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (window * group_windows)))

    def divide(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        lengths = group["length"].to_numpy()
        first = np.flatnonzero(np.diff(group["bundle"].to_numpy(), prepend=-1))
        at = np.repeat(windows_of(np.add.reduceat(lengths, first), window), np.diff(np.r_[first, len(lengths)]))
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
        base = np.repeat((ends - lengths[order])[first], np.diff(np.r_[first, len(order)]))
        return pd.DataFrame({
            "piece": group["piece"].to_numpy()[order],
            "sequence_id": 2 * ((int(key[0]) << 32) + at[order]),
            "offset": ends - lengths[order] - base,
        })

    packed = (
        rest.withColumn("group", F.pmod(F.xxhash64("bundle"), F.lit(groups)))
        .groupBy("group").applyInPandas(divide, "piece long, sequence_id long, offset long")
    )
    return Packed(pieces, alone.unionByName(packed))


def bundles(lengths: np.ndarray, small: int) -> np.ndarray:
    """How many places before each piece its bundle begins: runs of pieces under ``small``, up to twice that in all."""
    out = np.zeros(len(lengths), np.int64)
    total = size = 0
    for i, n in enumerate(lengths.tolist()):
        if n >= small or total + n > 2 * small:
            total = size = 0
        if n < small:
            out[i] = size
            total, size = total + n, size + 1
    return out


def windows_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """Window number of each piece; as few windows as differencing finds room in."""
    k = max(1, -(-int(lengths.sum()) // window))
    while True:
        at = difference(lengths, k)
        if np.bincount(at, lengths, minlength=k).max() <= window:
            return at
        k += 1


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """Divide ``lengths`` into ``k`` parts of nearly equal sums.

    Every piece begins as a partial partition with one part filled.  The two partial
    partitions that are most out of balance are merged, fullest parts with emptiest, until
    one is left; the merge order read backwards tells each piece its part.
    """
    n = len(lengths)
    sums: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)

    def parts(i: int) -> np.ndarray:
        if i < n:
            out = np.zeros(k, np.int64)
            out[0] = lengths[i]
            return out
        return sums.pop(i)

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = parts(a) + parts(b)[::-1]  # both fall from the first part to the last
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]  # what all parts have in common makes no difference
        new = n + len(merged)
        sums[new] = both
        merged.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(both[0]), new))

    at = np.zeros(n, np.int64)
    place = {n + len(merged) - 1: np.arange(k, dtype=np.int32)} if merged else {}
    for new in range(n + len(merged) - 1, n - 1, -1):
        a, b, order = merged[new - n]
        here = place.pop(new)  # final part of each of its sorted parts
        back = np.empty_like(here)
        back[order] = here
        for child, where in ((a, back), (b, back[::-1])):
            if child < n:
                at[child] = where[0]
            else:
                place[child] = where
    return at
