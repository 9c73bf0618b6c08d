"""Quality rules: counted line, symbol and repeat rules, and bands of n-gram perplexity.

The model is a modified Kneser-Ney model of four characters.  Letters of every script stay
apart; only white space is one character and digits are another.  Every language has a model
of its own.  Spark counts the n-grams over all documents, apart for two halves of the texts,
and works out what each keeps and leaves to shorter ones; every text is judged by the model
of the half it is not in, so that no text vouches for itself.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import FEW_GROUPS, PLAIN, blocks, chain_hash, lookup, mix, span_hash, spans, stored, text_bytes

#: Characters of an n-gram, of 16 bits each, so that an n-gram is one sorted 64-bit number.
ORDER, BITS = 4, 16
SPACE, DIGIT = 32, 48
OTHER = ""
#: N-grams of one length that a model sent to the tasks holds.  Languages with more are scored
#: by all of their n-grams: the most frequent are sent, the rest are joined.
GRAMS = 1 << 18
#: Bytes of models sent to the tasks at once; each document is scored in the round of its model.
LOT_BYTES = 64 << 20
#: N-grams a counting task holds before it hands them on.
HELD = 1 << 20
#: Half-width of a band in robust standard deviations of the log perplexity, and at least.
WIDTH, LEAST = 5.0, 0.1
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _mask(k: int) -> int:
    return (1 << BITS * k) - 1


@functools.lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """The 16 bits of each code point: itself, but one for white space and one for digits;
    those beyond 16 bits fold onto the others."""
    out = np.arange(0x110000)
    out[1 << BITS:] %= 65521
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = SPACE
        elif ch.isdigit():
            out[c] = DIGIT
    return out.astype(np.uint64)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram at every character of the texts, and the row of each; a text begins after
    white space."""
    lead = " " * (ORDER - 1)
    padded = [lead + t if t else "" for t in texts]
    codes = _characters()[np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.array([len(t) for t in padded], np.int64)
    rows = np.repeat(np.arange(len(texts)), lengths)
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = codes[:n].copy()
    for i in range(1, ORDER):
        grams = grams << np.uint64(BITS) | codes[i: n + i]
    whole = rows[:n] == rows[ORDER - 1:]
    return grams[whole], rows[:n][whole]


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray, np.ndarray, np.ndarray]]:
    """Model and half, their rows in the batch, their n-grams and the row of each among these."""
    of: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(batch.column("model").to_pylist(), batch.column("half").to_pylist())):
        of.setdefault(key, []).append(i)
    for key, at in of.items():
        yield key, np.array(at), *_grams(batch.column("text").take(pa.array(at)).to_pylist())


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts, sorted, and their counts."""
    grams, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(counts, first)


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each n-gram occurs in all texts of a ``model`` and ``half``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def size() -> int:
            return sum(len(grams) for parts in held.values() for grams, _ in parts)

        def given() -> Iterator[pa.RecordBatch]:
            for (model, half), parts in held.items():
                grams, counts = _summed(parts)
                for i in range(0, len(grams), 1 << 16):
                    some = grams[i: i + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({
                        "model": pa.array([model] * len(some), pa.string()),
                        "half": pa.array(np.full(len(some), half, np.int32)),
                        "gram": some.view(np.int64), "n": counts[i: i + (1 << 16)].astype(np.int64),
                    })
            held.clear()

        for batch in blocks(batches):
            for key, _, grams, _ in _by_model(batch):
                if len(grams):
                    held.setdefault(key, []).append(np.unique(grams, return_counts=True))
            if size() > 2 * HELD:
                for key, parts in held.items():
                    held[key] = [_summed(parts)]
                if size() > HELD:
                    yield from given()
        yield from given()

    return (
        docs.select("text", "model", "half").mapInArrow(count, "model string, half int, gram long, n long")
        .groupBy("model", "half", "gram").agg(F.sum("n").alias("n"))
    )


def _discount(i: int) -> Column:
    """The discount of counts of ``i`` (the last: and more) in modified Kneser-Ney, from the
    counts of counts ``n1`` to ``n4``."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))


def _cuts(grams: DataFrame, key: list[str], most: int) -> DataFrame:
    """The lowest ``step`` of each ``key`` down to which whole steps have ``most`` rows at most."""
    down = Window.partitionBy(*key).orderBy(F.desc("step"))
    steps = grams.groupBy(*key, "step").count().withColumn("upto", F.sum("count").over(down))
    return steps.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("upto") <= most, F.col("step"))), F.lit(1 << 30)).alias("cut"))


def shares(counted: DataFrame, most: int = GRAMS) -> DataFrame:
    """What every kept n-gram of each length ``k`` has of its context's probability
    (``mass``), and what the context leaves to the shorter n-gram (``left``).

    Below the top, what counts is the number of left neighbours.  Of one length at most
    ``most`` are kept: counts are taken in steps of an eighth of an octave, from the top, while
    whole steps fit, so nothing is ranked.  Sums go by context, which has 65 536 n-grams at most.
    """
    level, levels = counted.select("model", "half", "gram", "n"), []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            short = F.col("gram").bitwiseAND(F.lit(_mask(k)))
            level = level.groupBy("model", "half", short.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(level.withColumn("k", F.lit(k)))
    grams = stored(functools.reduce(DataFrame.unionByName, levels), "grams")
    grams = grams.withColumn("step", F.floor(F.log2("n") * 8).cast("int"))
    key = ["model", "half", "k"]
    tally = grams.groupBy(*key).agg(*[F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"n{i}") for i in range(1, 5)])
    cut = _cuts(grams, key, most)
    rules = tally.join(cut, key).select(*key, "cut", *[_discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    kept = F.when(F.col("step") >= F.col("cut"), F.col("n") - less).otherwise(0.0)
    context = Window.partitionBy(*key, F.shiftrightunsigned("gram", BITS))
    return grams.join(rules, key).withColumn("kept", kept).select(
        *key, "gram", (F.col("kept") / F.sum("n").over(context)).alias("mass"),
        (1 - F.sum("kept").over(context) / F.sum("n").over(context)).alias("left"),
    ).where("mass > 0")


@dataclass
class Level:
    """N-grams of one length in sorted arrays with their log probability, and the contexts
    with the log weight they leave to shorter ones (a context not here leaves all)."""

    grams: np.ndarray
    scores: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


@dataclass
class Table:
    """A model: log probability of an n-gram in the order ``ORDER``, whatever it is."""

    levels: list[Level]  # from one character up
    unseen: float

    def log_probability(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        if not k:
            return np.full(len(grams), self.unseen)
        level = self.levels[k - 1]
        out = np.zeros(len(grams))
        at, seen = lookup(level.grams, grams)
        out[seen] = level.scores[at[seen]]
        other = np.flatnonzero(~seen)
        if len(other):
            rest = grams[other]
            at, seen = lookup(level.contexts, rest >> np.uint64(BITS))
            out[other] = self.log_probability(rest & np.uint64(_mask(k - 1)), k - 1)
            out[other[seen]] += level.weights[at[seen]]
        return out


def build(k: np.ndarray, grams: np.ndarray, mass: np.ndarray, left: np.ndarray) -> Table:
    """A model of n-grams of all lengths with their ``shares``."""
    table = Table([], -np.log((k == 1).sum() + 1.0))
    for n in range(1, ORDER + 1):
        mine = np.flatnonzero(k == n)
        mine = mine[np.argsort(grams[mine])]
        here, weights = grams[mine], left[mine]
        lower = np.exp(table.log_probability(here & np.uint64(_mask(n - 1)), n - 1))
        contexts, first = np.unique(here >> np.uint64(BITS), return_index=True)
        scores, weights = (np.log(np.maximum(x, 1e-12)).astype(np.float32) for x in (mass[mine] + weights * lower, weights[first]))
        table.levels.append(Level(here, scores, contexts, weights))
    return table


def learn(counted: DataFrame, most: int = GRAMS) -> DataFrame:
    """The model of each ``model`` and ``half`` as arrays, a row for each length, stored.

    A group holds at most ``ORDER * most`` rows.
    """
    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        table = build(group["k"].to_numpy(), group["gram"].to_numpy().view(np.uint64),
                      group["mass"].to_numpy(), group["left"].to_numpy())
        return pd.DataFrame([(key[0], key[1], k, table.unseen, *(x.tobytes() for x in (
            level.grams, level.scores, level.contexts, level.weights))) for k, level in enumerate(table.levels)],
            columns=["model", "half", "k", "unseen", "grams", "scores", "contexts", "weights"])

    return stored(shares(counted, most).groupBy("model", "half").applyInPandas(
        fit, "model string, half int, k int, unseen double, grams binary, scores binary, contexts binary, weights binary"), "models")


def tables_of(models: DataFrame) -> dict[tuple[str, int], Table]:
    """The models of a stored table; only of those that fit into one lot."""
    of: dict[tuple[str, int], Table] = {}
    for r in sorted(models.collect(), key=lambda r: r["k"]):
        table = of.setdefault((r["model"], r["half"]), Table([], r["unseen"]))
        table.levels.append(Level(*(np.frombuffer(r[c], t) for c, t in (
            ("grams", np.uint64), ("scores", np.float32), ("contexts", np.uint64), ("weights", np.float32)))))
    return of


def lots_of(models: DataFrame, most: int = LOT_BYTES) -> list[list[str]]:
    """Languages in lots whose models have ``most`` bytes together; one language a lot at least."""
    size = sum(F.coalesce(F.length(c), F.lit(0)) for c in ("grams", "scores", "contexts", "weights"))
    lots, used = [[]], 0
    for r in models.groupBy("model").agg(F.sum(size).alias("size")).orderBy("model").collect():  # a narrow row a language
        if lots[-1] and used + r["size"] > most:
            lots.append([])
            used = 0
        lots[-1].append(r["model"])
        used += r["size"]
    return lots


def text_rules(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of words, their characters, symbols, repeated lines and words in repeated
    three-word windows, for each text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    starts, ends, rows = spans(PLAIN[data], offsets)
    letters = PLAIN[data] & (data & 0xC0 != 0x80)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return sums[offsets[1:]] - sums[offsets[:-1]]

    repeated = np.zeros(len(starts), bool)
    keys, first = chain_hash(span_hash(data, starts, ends), rows, 3)
    if len(keys):
        keys = mix(keys ^ mix(rows[first].astype(np.uint64)))
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = first[times[which] > 1]
        for i in range(3):
            repeated[again + i] = True
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            worded = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
            lines[i] = len(worded) - len(set(worded))
    return {
        "n_words": np.bincount(rows, minlength=n), "word_chars": total(letters), "n_symbols": total(SYMBOLS[data]),
        "n_dup_lines": lines, "n_repeat_words": np.bincount(rows[repeated], minlength=n),
    }


def exact_scores(counted: DataFrame) -> DataFrame:
    """``counted`` with ``score``, the log probability of each n-gram in the model of the other half
    (its own where there is no other), by all n-grams of every length; stored."""
    key = ["model", "asked"]
    every = stored(shares(counted, 1 << 62), "shares").withColumnRenamed("half", "asked")
    unseen = every.where("k = 1").groupBy(*key).agg((1 / (F.count(F.lit(1)) + 1)).alias("p0"))
    halves = counted.groupBy("model").agg(F.countDistinct("half").alias("halves"))
    asked = F.when(F.col("halves") == 2, 1 - F.col("half")).otherwise(F.col("half"))
    rows = counted.join(halves, "model").withColumn("asked", asked).drop("halves").join(unseen, key)
    below, score = unseen, F.col("p0")
    for k in range(1, ORDER + 1):
        part = F.col("gram") if k == ORDER else F.col("gram").bitwiseAND(F.lit(_mask(k)))
        here = every.where(F.col("k") == k).drop("k")
        contexts = here.groupBy(*key, F.shiftrightunsigned("gram", BITS).alias("context")).agg(F.first("left").alias(f"w{k}"))
        on = [*key] if k == 1 else [*key, "short"]
        here = here.withColumn("short", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(below, on)
        seen = stored(here.select(*key, F.col("gram").alias("part"), (F.col("mass") + F.col("left") * F.col(f"p{k - 1}")).alias(f"p{k}")), "seen")
        rows = rows.withColumn("part", part).withColumn("context", F.shiftrightunsigned(part, BITS))
        rows = rows.join(seen, [*key, "part"], "left").join(contexts, [*key, "context"], "left")
        score = F.coalesce(f"p{k}", F.coalesce(f"w{k}", F.lit(1.0)) * score)
        below = seen.withColumnRenamed("part", "short")
    return stored(rows.select("model", "half", "gram", "n", F.log(F.greatest(score, F.lit(1e-12))).alias("score")), "scores")


def frequent(scores: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent n-grams of each ``model`` and ``half`` with their scores, as ``learn`` stores a length."""
    key = ["model", "half"]
    grams = scores.withColumn("step", F.floor(F.log2("n") * 8).cast("int"))

    def fit(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(grams := group["gram"].to_numpy().view(np.uint64))
        found = (grams[order].tobytes(), group["score"].to_numpy().astype(np.float32)[order].tobytes())
        return pd.DataFrame([(*at, ORDER, 0.0, *found, b"", b"")], columns=["model", "half", "k", "unseen", "grams", "scores", "contexts", "weights"])

    return stored(grams.join(_cuts(grams, key, most), key).where("step >= cut").groupBy(*key).applyInPandas(
        fit, "model string, half int, k int, unseen double, grams binary, scores binary, contexts binary, weights binary"), "frequent")


def measure_all(docs: DataFrame, counted: DataFrame, most: int, lot_bytes: int) -> DataFrame:
    """What ``measure`` gives, for languages with more n-grams than a model holds, by all of them.

    The most frequent n-grams are looked up in the tasks; of the rest each text gives its
    distinct ones with their number, which are joined with the scores.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    scores = exact_scores(counted)
    models = frequent(scores, most)
    languages = counted.select("model").distinct()
    models = languages.join(models, "model", "left")  # also those of which no step is sent
    docs = docs.withColumn("row_no", F.monotonically_increasing_id())

    def scorer(tables):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                sums, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                rest: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for key, at, grams, rows in _by_model(batch):
                    table = tables.value.get(key)
                    known = table.levels[0] if table else Level(*(np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)))
                    place, seen = lookup(known.grams, grams)
                    sums[at] = np.bincount(rows[seen], known.scores[place[seen]], len(at))
                    n[at] = np.bincount(rows, minlength=len(at))
                    order = np.lexsort((grams[~seen], rows[~seen]))
                    of, other = rows[~seen][order], grams[~seen][order]
                    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (other[1:] != other[:-1])][: len(of)])
                    times = np.diff(np.r_[first, len(of)])
                    for i, gram, t in zip(at[of[first]].tolist(), other[first].view(np.int64).tolist(), times.tolist()):
                        rest[i].append({"gram": gram, "times": t})
                rules = text_rules(batch.column("text"))
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c) for c in ("doc_id", "row_no", "model", "half", "digest")},
                    **{k: pa.array(v.astype(np.int64)) for k, v in rules.items()},
                    "sums": sums, "characters": n, "rest": pa.array(rest, pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))),
                })

        return score

    done = []
    for lot in lots_of(models, lot_bytes):
        number = spark.createDataFrame([(m,) for m in lot], "model string")
        tables = spark.sparkContext.broadcast(tables_of(models.where("grams IS NOT NULL").join(number, "model", "left_semi")))
        done.append(stored(docs.join(number, "model", "left_semi").mapInArrow(
            scorer(tables), f"doc_id {kind}, row_no long, model string, half int, digest long, n_words long, word_chars long, n_symbols long, "
                            "n_dup_lines long, n_repeat_words long, sums double, characters long, rest array<struct<gram:long,times:long>>"), "sums"))
        tables.unpersist()
    rows = functools.reduce(DataFrame.unionByName, done)
    rest = rows.select("row_no", "model", "half", F.explode("rest").alias("r")).select("row_no", "model", "half", "r.*")
    more = rest.join(scores, ["model", "half", "gram"]).groupBy("row_no").agg(F.sum(F.col("times") * F.col("score")).alias("more"))
    mean = F.when(F.col("characters") > 0, -(F.col("sums") + F.coalesce("more", F.lit(0.0))) / F.col("characters"))
    return stored(rows.join(more, "row_no", "left").select(
        "doc_id", "model", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", mean.alias("log_perplexity")), "measures")


def measure(docs: DataFrame, lot_bytes: int = LOT_BYTES, most: int = GRAMS) -> DataFrame:
    """Every document's rule counts, its ``model`` (language) and its mean log perplexity a
    character (null for empty texts), stored.  Languages of more than ``most`` n-grams in one
    half go through ``measure_all``, so that none is left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(
        "doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(OTHER)).alias("model"), F.xxhash64("text").alias("digest"),
    ).withColumn("half", F.pmod("digest", F.lit(2)).cast("int"))
    spark = docs.sparkSession
    counted = stored(count_grams(docs), "counts")
    # shorter n-grams are fewer than those of four
    large = stored(counted.groupBy("model", "half").count().where(F.col("count") > most).select("model").distinct(), "large")
    apart = []
    if large.limit(1).count():
        apart = [measure_all(docs.join(large, "model", "left_semi"), counted.join(large, "model", "left_semi"), most, lot_bytes)]
        docs, counted = (df.join(large, "model", "left_anti") for df in (docs, counted))
    models = learn(counted, most)
    lots = lots_of(models, lot_bytes)

    def scorer(tables):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                mean = np.full(batch.num_rows, np.nan)
                for (model, half), at, grams, rows in _by_model(batch):
                    table = tables.value.get((model, 1 - half)) or tables.value.get((model, half))
                    if table is not None and len(grams):
                        sums = np.bincount(rows, table.log_probability(grams), len(at))
                        with np.errstate(invalid="ignore"):
                            mean[at] = -sums / np.bincount(rows, minlength=len(at))
                rules = text_rules(batch.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "model": batch.column("model"), "digest": batch.column("digest"),
                    **{k: pa.array(v.astype(np.int64)) for k, v in rules.items()},
                    "log_perplexity": pa.array(mean, pa.float64(), from_pandas=True),
                })

        return score

    done = apart
    for i, lot in enumerate(lots):
        mine, asked = docs, models
        if len(lots) > 1:  # languages without any text have no model and go with the first lot
            number = spark.createDataFrame([(m, n) for n, ms in enumerate(lots) for m in ms], "model string, _lot int")
            mine = docs.join(number, "model", "left").where(F.coalesce("_lot", F.lit(0)) == i).drop("_lot")
            asked = models.join(number.where(F.col("_lot") == i), "model", "left_semi")
        tables = spark.sparkContext.broadcast(tables_of(asked))
        done.append(stored(mine.mapInArrow(
            scorer(tables), f"doc_id {kind}, model string, digest long, n_words long, word_chars long, n_symbols long, "
                            "n_dup_lines long, n_repeat_words long, log_perplexity double"), "measures"))
        tables.unpersist()
    return functools.reduce(DataFrame.unionByName, done)


def bands(measured: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """Lower and upper log perplexity for each model, around the median of different texts.

    A group of copies counts once, however large.  The band is ``width`` robust standard
    deviations wide to either side, and at least ``least``.
    """
    texts = measured.where("log_perplexity IS NOT NULL").groupBy("model", "digest").agg(
        F.first("log_perplexity").alias("x"))
    quarter = texts.groupBy("model").agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q"))
    half = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349 * width, F.lit(least))
    return quarter.select("model", (F.col("q")[1] - half).alias("low"), (F.col("q")[1] + half).alias("high"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """Rule counts, ``base_failed``, ``perplexity`` and ``kept`` for every document.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeated`` percent of
    them in repeated windows.  ``kept``: not that, and a perplexity within its language's
    band.  Null texts count as empty and fail; a null language has the model ``""``;
    null ids and repeated rows are ordinary rows; an empty table gives none.  Columns other
    than ``doc_id``, ``text`` and ``lang`` are not read.
    """
    measured = measure(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    limits = stored(bands(measured), "bands")  # a narrow row for each language
    if limits.count() <= FEW_GROUPS:
        limits = F.broadcast(limits)
    return measured.join(limits, "model", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("lowest"), F.exp("high").alias("highest"))
