"""Quality of documents by co-training a content view and a metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import PLAIN, aside, blocks, held_out, mix, restored, sample_by, span_hash, spans, stored, text_bytes, widened
from memloom.llm.perplexity import text_rules
from memloom.llm.toxicity import logistic

#: Labelled rows of each label that a view is fitted on, and confident rows of each label
#: that a view hands to the other in a round: a share of all by digest.
SAMPLE_ROWS, HANDED_ROWS = 10_000, 5_000
ROUNDS = 3
#: Calibrated belief from which a view hands a row over.
CONFIDENT = 0.97
#: A handed row counts less than a labelled one.
HANDED_WEIGHT = 0.5
#: Values of one metadata column that have a place of their own, the most frequent of all
#: documents; all others share one.
PLACES = 256
#: Steps of the size of a text.
STEPS = 16
#: Scale of metadata places: one for all, so that the ridge holds rare values near zero.
PLACE_SCALE = 0.5

VIEWS = ("content", "metadata")
_BYTES = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "upper": bytes(range(65, 91)), "letter": bytes([*range(65, 91), *range(97, 123)]), "digit": b"0123456789",
    "end": b".?;:,", "shout": b"!", "line": b"\n", "quote": b"\"'()[]{}",
}.items()} | {"beyond": np.arange(256) >= 128}


def content_features(column: pa.Array) -> np.ndarray:
    """What a text looks like, from the text alone: one row of numbers for each text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    rules = text_rules(column)
    words = np.maximum(rules["n_words"], 1)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return sums[offsets[1:]] - sums[offsets[:-1]]

    count = {name: total(mask[data]) for name, mask in _BYTES.items()}
    starts, ends, rows = spans(PLAIN[data], offsets)
    lengths = ends - starts
    pairs = np.unique(mix(span_hash(data, starts, ends) ^ mix(rows.astype(np.uint64))), return_index=True)[1]
    out = np.column_stack([
        np.log1p(rules["n_words"]),
        rules["word_chars"] / words / 10,
        np.bincount(rows[pairs], minlength=n) / words,
        rules["n_repeat_words"] / words,
        np.log1p(rules["n_dup_lines"]),
        np.sqrt(rules["n_symbols"] / size),
        np.sqrt(count["upper"] / np.maximum(count["letter"], 1)),
        np.sqrt(count["shout"] / size),
        count["end"] / words,
        count["line"] / words,
        count["digit"] / size,
        count["quote"] / size,
        count["beyond"] / size,
        np.bincount(rows[lengths <= 3], minlength=n) / words,
        np.bincount(rows[lengths > 12], minlength=n) / words,
        rules["n_words"] == 0,
    ]).astype(float)
    return np.column_stack([out, out ** 2]).astype(np.float32)


def frequent_values(docs: DataFrame, values: tuple[str, ...]) -> list[list[str | None]]:
    """The ``PLACES`` most frequent values of each column, null among them, equal counts by value."""
    return [[r[0] for r in docs.groupBy(F.col(v).cast("string").alias("v")).count()
             .orderBy(F.desc("count"), F.asc_nulls_first("v")).limit(PLACES).collect()] for v in values]


def metadata_features(values: list[pa.Array], sizes: pa.Array, known: list[list[str | None]]) -> np.ndarray:
    """For each row the number of all places, and the places that are one: a value of each column, and a step of the size."""
    columns, start = [], 0
    for column, own in zip(values, known):
        at = pc.fill_null(pc.index_in(column.cast(pa.string()), value_set=pa.array(own, pa.string())), len(own))
        columns.append(start + at.to_numpy(zero_copy_only=False).astype(np.int32))
        start += len(own) + 1
    size = sizes.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    step = np.clip(np.log2(1 + np.maximum(np.nan_to_num(size), 0)), 0, STEPS - 1).astype(np.int32)
    width = np.full(len(sizes), start + STEPS, np.int32)
    return np.column_stack([width, *columns, start + step]).astype(np.int32)


@dataclass
class View:
    """Logistic weights over scaled features, and the line that calibrates their log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: tuple[float, float] = (0.0, 1.0)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:]
        return np.clip(self.line[0] + self.line[1] * z, -12, 12)


@dataclass
class Model:
    """Both views, and the log odds of a good document before anything is looked at."""

    views: list[View] = field(default_factory=list)
    prior: float = 0.0

    def log_odds(self, features: list[np.ndarray]) -> list[np.ndarray]:
        if not self.views:
            return [np.full(len(x), self.prior) for x in features]
        return [view.log_odds(x) for view, x in zip(self.views, features)]

    def combine(self, odds: list[np.ndarray]) -> np.ndarray:
        """The views' evidence added up: the prior, which each of them holds, counts once."""
        return sum(odds) - (len(odds) - 1) * self.prior


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, labelled: np.ndarray, fold: np.ndarray,
             places: bool = False) -> View:
    """Weights from all rows but the labelled ones of ``fold``, which calibrate them.

    Numbers are scaled by their spread, ``places`` (0 or 1) all alike.
    """
    own = ~(labelled & fold)
    if len(np.unique(y[own])) < 2 or len(np.unique(y[labelled & fold])) < 2:
        own = np.ones(len(y), bool)  # too few labels to keep some back
    mean = x[own].mean(axis=0)
    scale = np.full(x.shape[1], PLACE_SCALE) if places else np.maximum(x[own].std(axis=0), 1e-3)
    view = View(mean, scale, logistic((x[own] - mean) / scale, y[own], weight[own], ridge=1.0))
    back = labelled & fold if not own.all() else labelled
    z = view.log_odds(x[back])
    view.line = tuple(logistic(z[:, None], y[back], np.ones(back.sum()), ridge=0.1).tolist())
    if view.line[1] < 0:  # a view that says nothing is no evidence the other way round
        rate = np.clip(y[back].mean(), 0.01, 0.99)
        view.line = (float(np.log(rate / (1 - rate))), 0.0)
    return view


def features(docs: DataFrame, values: tuple[str, ...] = ("source", "lang"), size: str = "n_chars",
             carry: bool = False) -> DataFrame:
    """Both views of every document, stored: blobs ``content`` and ``metadata``, and a digest.

    ``carry`` keeps ``text`` and all other columns of ``docs`` beside them (see ``aside``).
    """
    base = docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("digest"),
        *[F.col(v).cast("string").alias(f"v{i}") for i, v in enumerate(values)],
        F.col(size).cast("double").alias("size"), *[aside(docs)] * carry)
    kept = ["doc_id", "digest", *["text", "given"] * carry]
    schema = widened(base.select(*kept).schema, content="binary", metadata="binary")
    n = len(values)
    known = frequent_values(docs, values)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            views = (content_features(batch.column("text")),
                     metadata_features([batch.column(f"v{i}") for i in range(n)], batch.column("size"), known))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *(pa.array([row.tobytes() for row in v], pa.binary()) for v in views)],
                names=[*kept, *VIEWS])

    return stored(base.mapInArrow(make, schema), "features")


def with_labels(made: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with ``label`` (1 good, 0 bad, null unknown) where one may be learned from."""
    own = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min((F.col("quality") != 0).cast("int")).alias("label"))
    )
    return made.select("doc_id", "digest", *VIEWS).join(own, "doc_id", "left")


def _numbers(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1) if blobs else np.zeros((0, 1), kind)


def _matrix(view: str, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of numbers out of the blobs of a view."""
    if view == "content":
        return _numbers(column, np.float32).astype(float)
    places = _numbers(column, np.int32)
    out = np.zeros((len(places), int(places[0, 0]) if len(places) else 1))
    out[np.arange(len(places))[:, None], places[:, 1:]] = 1
    return out


def _score(table: DataFrame, model: Model) -> DataFrame:
    """``table`` with the log odds of each view instead of its blobs."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in table.columns if c not in VIEWS]
    schema = widened(table.select(*kept).schema, **{f"{name}_odds": "double" for name in VIEWS})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                odds = shared.value.log_odds([_matrix(v, batch.column(v)) for v in VIEWS])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *map(pa.array, odds)],
                                                 names=[*kept, *(f"{v}_odds" for v in VIEWS)])

    return table.mapInArrow(score, schema)


def co_train(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit both views on labelled rows, then let each teach the other.

    In every round both calibrated views score all documents; the rows of which a view is
    sure go to the other one as training rows of that label.  Rows that are labelled are
    never relabelled.  Fits are made on bounded samples (``SAMPLE_ROWS``, ``HANDED_ROWS``);
    scoring covers everything.
    """
    known = table.where("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:  # nothing to tell apart
        return Model(prior=12.0 if sizes.get(1) else -12.0 if sizes else 0.0)
    rows = sample_by(known, "label", SAMPLE_ROWS).select("digest", "label", *VIEWS).dropDuplicates(["digest"]).toArrow()
    x = [_matrix(v, rows.column(v)) for v in VIEWS]
    y = rows.column("label").to_numpy().astype(float)
    weight = np.array([max(1.0, sizes[int(label)] / SAMPLE_ROWS) for label in y])
    fold = rows.column("digest").to_numpy().view(np.uint64) % np.uint64(4) == 0
    labelled = np.ones(len(y), bool)
    rate = sizes[1] / sum(sizes.values())
    model = Model([fit_view(v, y, weight, labelled, fold, name != "content") for name, v in zip(VIEWS, x)], float(np.log(rate / (1 - rate))))
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    fresh = table.where("label IS NULL")
    for _ in range(rounds):
        scored = stored(_score(fresh.select("digest", *VIEWS), model), "odds")
        views = []
        for i, view in enumerate(VIEWS):
            teacher = F.col(f"{VIEWS[1 - i]}_odds")
            confident = scored.where(F.abs(teacher) >= sure).withColumn("taught", (teacher > 0).cast("int"))
            handed = sample_by(confident.select("digest", "taught"), "taught", HANDED_ROWS).distinct()
            # about twice HANDED_ROWS narrow rows
            more = (fresh.select("digest", view).join(F.broadcast(handed), "digest")
                    .dropDuplicates(["digest"]).toArrow())
            given = more.column("taught").to_numpy().astype(float)
            extra = _matrix(view, more.column(view)) if len(given) else np.zeros((0, x[i].shape[1]))
            views.append(fit_view(
                np.vstack([x[i], extra]), np.r_[y, given], np.r_[weight, np.full(len(given), HANDED_WEIGHT)],
                np.r_[labelled, np.zeros(len(given), bool)], np.r_[fold, np.zeros(len(given), bool)],
                view != "content"))
        model = Model(views, model.prior)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, carry: bool = False, **columns) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher is better) and the belief of each view.

    Null and empty texts, null metadata, null ids and repeated rows are scored like any
    other row.  Without labels of both kinds the score is what the labels say, or 0.5
    where there are none.  A value of a metadata column has a place of its own if it is
    among the ``PLACES`` most frequent.  An empty table gives none.  Labels of held-out ids are not used;
    an id labelled twice is bad if any label says so.
    """
    table = features(docs, carry=carry, **columns)
    model = co_train(with_labels(table, labels), rounds)
    odds = _score(table.drop("digest"), model)
    both = F.col("content_odds") + F.col("metadata_odds") - F.lit(model.prior)

    def belief(z):
        return 1 / (1 + F.exp(-z))

    return odds.select(
        "doc_id", *["text", "given"] * carry, belief(both).alias("score"),
        belief(F.col("content_odds")).alias("content_score"), belief(F.col("metadata_odds")).alias("metadata_score"))


def keep_good(docs: DataFrame, labels: DataFrame, floor: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``floor``, with all their columns."""
    return score_quality(docs, labels, carry=True).where(F.col("score") >= floor).select(*restored(docs.columns))
