"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import ALNUM, blocks, held_out, lookup, sample_by, span_hash, text_bytes, word_spans

#: Labelled documents learned from, for each label: a share of all by the digest of the id.
SAMPLE_ROWS = 10_000
#: Words with a score, those furthest from chance, and how far (in standard deviations).
WORDS, FURTHEST = 50_000, 3.0
#: Weight of the prior, in documents, shared out by how many documents hold a word.
PRIOR = 20.0
#: What every token costs, so that a segment of ordinary text has no positive score.
COST = 0.25
#: Expected number of chance passages as good in a text, up to which a passage is significant.
SIGNIFICANT = 0.05


@dataclass
class Model:
    """Sorted word hashes with their log-odds; ``rate`` and ``scale`` of the extreme values
    of segment scores in clean text; weights of the calibration."""

    hashes: np.ndarray
    odds: np.ndarray
    rate: float = 1.0
    scale: float = 0.1
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score, row, first and last byte of every token."""
        data, starts, ends, rows = word_spans(column, ALNUM)
        at, known = lookup(self.hashes, span_hash(data, starts, ends))
        scores = np.full(len(starts), -COST)
        scores[known] += self.odds[at[known]]
        return scores, rows, starts, ends

    def passages(self, column: pa.Array) -> tuple[list[list[dict]], np.ndarray]:
        """Significant passages of each text, and the two figures that a score is made of."""
        n = len(column)
        scores, rows, starts, ends = self.tokens(column)
        edges = np.searchsorted(rows, np.arange(n + 1))
        sums = np.r_[0.0, np.cumsum(scores)]
        origin = text_bytes(column)[1]
        good = np.flatnonzero(scores > 0)
        bounds = np.searchsorted(rows[good], np.arange(n + 1))
        found: list[list[dict]] = []
        figures = np.zeros((n, 2))
        for i in range(n):
            mine = good[bounds[i]: bounds[i + 1]]
            out = []
            if len(mine):
                segments = maximal_segments(sums[mine].tolist(), sums[mine + 1].tolist())
                # nats above the best that chance gives in a text of this many tokens
                floor = np.log(self.scale * (edges[i + 1] - edges[i]))
                above = [self.rate * s - floor for _, _, s in segments]
                figures[i] = max(above), sum(x for x in above if x > 0)
                for (a, b, s), x in zip(segments, above):
                    if np.exp(-x) <= SIGNIFICANT:
                        out.append({"first": int(mine[a] - edges[i]), "last": int(mine[b] - edges[i]),
                                    "first_byte": int(starts[mine[a]] - origin[i]),
                                    "end_byte": int(ends[mine[b]] - origin[i]), "score": float(s),
                                    "expected": float(np.exp(-x))})
            found.append(out)
        return found, figures

    def probability(self, figures: np.ndarray) -> np.ndarray:
        z = self.weights[0] + figures_of(figures) @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def figures_of(figures: np.ndarray) -> np.ndarray:
    """Best and total excess over chance, on a scale that grows slowly."""
    return np.log1p(np.maximum(figures, 0))


def maximal_segments(before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs among tokens, in time linear in the tokens of positive score.

    ``before`` and ``after`` are the running sums before and after each positive token; the
    sums in between have fallen by what the other tokens cost.  Each candidate remembers the
    last candidate that begins lower, so no candidate is looked at again in vain.
    """
    first: list[int] = []
    last: list[int] = []
    left: list[float] = []
    right: list[float] = []
    lower: list[int] = []
    for k, (a, b) in enumerate(zip(before, after)):
        begin, low, high = k, a, b
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= high:
                break
            begin, low = first[j], left[j]
            del first[j:], last[j:], left[j:], right[j:], lower[j:]
            j -= 1
        first.append(begin)
        last.append(k)
        left.append(low)
        right.append(high)
        lower.append(j)
    return [(f, e, h - low) for f, e, low, h in zip(first, last, left, right)]


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text``, ``toxic``, ``weight`` and ``fold`` of a bounded sample of the labelled rows.

    Rows whose id is held out and rows without a label or id are no part of it; an id with
    both labels counts as toxic.  ``weight`` makes up for the share of each label taken.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
        .withColumn("digest", F.xxhash64("doc_id"))
    )
    taken = sample_by(known, "toxic", sample_rows)
    sizes = known.groupBy("toxic").count()
    taken = taken.join(F.broadcast(sizes), "toxic").select(
        "doc_id", "toxic", F.greatest(F.lit(1.0), F.col("count") / sample_rows).alias("weight"),
        (F.pmod("digest", F.lit(3)) == 0).cast("int").alias("fold"))
    # about 2 * sample_rows narrow rows
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").drop("doc_id")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Log-odds of words from two thirds of the sample, calibration from the other third."""
    sample = labelled(docs, labels, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            toxic = batch.column("toxic").to_numpy()
            data, starts, ends, rows = word_spans(batch.column("text"), ALNUM)
            pairs = np.unique(np.stack([span_hash(data, starts, ends).view(np.int64), rows]), axis=1)
            keys, at = np.unique(pairs[0], return_inverse=True)
            bad = np.bincount(at, toxic[pairs[1]], len(keys))
            yield pa.RecordBatch.from_pydict({
                "hash": keys, "toxic": pa.array(bad.astype(np.int64)),
                "clean": pa.array((np.bincount(at, minlength=len(keys)) - bad).astype(np.int64))})

    training = sample.where("fold = 0")
    counted = (
        training.select("text", "toxic")
        .mapInArrow(count, "hash long, toxic long, clean long")
        .groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    totals = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    n = [float(totals.get(i, 0)) for i in (0, 1)]
    if not n[0] or not n[1]:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    prior = (F.col("toxic") + F.col("clean")) / sum(n) * PRIOR
    bad, good = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(bad / (n[1] + PRIOR - bad)) - F.log(good / (n[0] + PRIOR - good))
    far = F.abs(odds) / F.sqrt(1 / bad + 1 / good)
    kept = (
        counted.select("hash", odds.alias("odds"), far.alias("far")).where(F.col("far") >= FURTHEST)
        .orderBy(F.desc("far"), "hash").limit(WORDS).toArrow()
    )
    hashes = kept.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], kept.column("odds").to_numpy()[order])
    return calibrate(model, sample)


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Set the extreme-value law from clean documents and the weights from both labels."""
    shared = sample.sparkSession.sparkContext.broadcast(model)  # at most WORDS entries

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values, counts = np.unique(np.round(shared.value.tokens(batch.column("text"))[0], 2), return_counts=True)
            yield pa.RecordBatch.from_pydict({"x": values, "n": pa.array(counts, pa.int64())})

    clean = sample.where("toxic = 0").select("text").mapInArrow(histogram, "x double, n long")
    seen = clean.groupBy("x").agg(F.sum("n").alias("n")).collect()
    model.rate, model.scale = extreme_values(np.array([r["x"] for r in seen]), np.array([r["n"] for r in seen], float))

    shared = sample.sparkSession.sparkContext.broadcast(model)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            both = shared.value.passages(batch.column("text"))[1]
            yield pa.RecordBatch.from_pydict({"best": both[:, 0], "total": both[:, 1],
                                              "toxic": batch.column("toxic"), "weight": batch.column("weight")})

    rows = sample.where("fold = 1").select("text", "toxic", "weight").mapInArrow(
        figures, "best double, total double, toxic int, weight double").toArrow()
    x = figures_of(np.stack([rows.column("best").to_numpy(), rows.column("total").to_numpy()], 1))
    y, w = rows.column("toxic").to_numpy().astype(float), rows.column("weight").to_numpy()
    model.weights = tuple(logistic(x, y, w).tolist())
    return model


def extreme_values(scores: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Rate and scale of the law of best segment scores, from the scores of clean tokens.

    The rate is the positive root of E[exp(rate * score)] = 1.  The scale takes a segment
    to begin where a positive score follows another: the share of those times the rate's
    loss, which errs to the careful side.  Without a positive score any rate is right.
    """
    share = counts / max(counts.sum(), 1)
    if not len(scores) or scores.max() <= 0:
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    if share @ scores >= 0:
        return 0.05, 1.0
    while share @ np.exp(np.minimum(high * scores, 500)) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        if share @ np.exp(np.minimum(middle * scores, 500)) < 1:
            low = middle
        else:
            high = middle
    drift = -(share @ (scores * np.exp(np.minimum(low * scores, 500)))) / min(share @ scores, -1e-9)
    return low, float(np.clip(1 / max(drift, 1.0), 1e-3, 1.0))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)),
                               x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return beta


PASSAGE = "struct<first: long, last: long, first_byte: long, end_byte: long, score: double, expected: double>"


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and every significant passage of every text.

    A passage has its first and last word (from 0), its bytes in the text, its score and
    how many such passages chance would give.  Null and empty texts have none and get the
    score of a text without one; null ids and repeated rows are ordinary rows.  Only
    ``doc_id`` and ``text`` are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS entries

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("first_byte", pa.int64()),
                                 ("end_byte", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in blocks(batches):
            found, figures = shared.value.passages(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              "score": shared.value.probability(figures), "passages": pa.array(found, of)})

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, passages array<{PASSAGE}>")
