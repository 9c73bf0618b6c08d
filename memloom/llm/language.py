"""Language of a text: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import blocks, held_out, lookup, sample_by, span_hash, spans, widened

#: Different labelled texts learned from, for each language: a share of all by digest.
SAMPLE_ROWS = 2000
#: Words, and n-grams of each order, kept for each language: the most frequent.
WORDS, GRAMS = 40_000, 20_000
#: Longest character n-gram; the word's two ends count as spaces.
ORDER = 5
#: What a language without the word or n-gram loses, as a factor on its rarest entry.
PENALTY = 0.1

UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts; start, end and row of each run of letters."""
    low = [(t or "").lower() for t in texts]
    offsets = np.cumsum([0, *map(len, low)])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, *spans(_letters()[codes], offsets)


def _padded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words one after the other, each between two spaces: codes, starts, ends."""
    lengths = ends - starts + 2
    edges = np.cumsum(np.r_[0, lengths])
    out = np.full(edges[-1], 32, np.uint32)
    within = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    inner = (within > 0) & (within < np.repeat(lengths, lengths) - 1)
    out[inner] = codes[(np.repeat(starts - 1, lengths) + within)[inner]]
    return out, edges[:-1], edges[1:]


def _grams(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each n-gram of each span, and the span it is in."""
    counts = np.maximum(ends - starts - n + 1, 0)
    which = np.repeat(np.arange(len(starts)), counts)
    return starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts), which


@dataclass
class Model:
    """Sorted hashes and a row of log frequencies by language: words at 0, n-grams at n."""

    languages: list[str]
    hashes: list[np.ndarray]
    scores: list[np.ndarray]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and share of the belief it has (0 to 1) for every text.

        Texts without a letter get ``und`` and 0.  Ties go to the first language by name.
        """
        codes, starts, ends, rows = _words(texts)
        n, k = len(texts), len(self.languages)
        if not k or not len(starts):
            return [UNKNOWN] * n, np.zeros(n)
        hashes, first, word = np.unique(span_hash(codes, starts, ends), return_index=True, return_inverse=True)
        by_word = self.word_scores(hashes, codes, starts[first], ends[first])
        count = np.bincount(rows, minlength=n)
        # a word seen nowhere, not by one letter, says nothing about the language
        mean = np.stack([np.bincount(rows, by_word[word, i], n) for i in range(k)], 1) / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        weight = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.sqrt(np.maximum(count, 1))[:, None])
        belief = np.where(count > 0, 1 / weight.sum(axis=1), 0.0)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best, count)], belief

    def word_scores(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log frequency of each word by language, of the longest units that are known."""
        out = np.zeros((len(hashes), len(self.languages)), np.float32)
        at, known = lookup(self.hashes[0], hashes)
        out[known] = self.scores[0][at[known]]
        open_ = np.flatnonzero(~known)
        for n in range(ORDER, 0, -1):
            if not len(open_):
                break
            padded, begin, end = _padded(codes, starts[open_], ends[open_])
            gram, which = _grams(begin, end, n)
            at, found = lookup(self.hashes[n], span_hash(padded, gram, gram + n))
            which, at = which[found], at[found]
            hits = np.bincount(which, minlength=len(open_))
            for i in range(len(self.languages)):
                total = np.bincount(which, self.scores[n][at, i], len(open_))
                out[open_, i] = total / np.maximum(hits, 1)
            open_ = open_[hits == 0]
        return out


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Log frequencies from a bounded sample of the rows of ``docs`` that name a language.

    About ``sample_rows`` different texts of each language are taken by digest; what is kept
    is bounded by ``WORDS`` and ``GRAMS`` for each language, however large ``docs`` is.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("digest"))
    sample = sample_by(rows, "lang", sample_rows).groupBy("lang", "digest").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            names, language = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(object),
                                        return_inverse=True)
            codes, starts, ends, rows = _words(batch.column("text").to_pylist())
            padded, begin, end = _padded(codes, starts, ends)
            for n in range(ORDER + 1):
                if n:
                    gram, which = _grams(begin, end, n)
                    hashes, of = span_hash(padded, gram, gram + n), language[rows[which]]
                else:
                    hashes, of = span_hash(codes, starts, ends), language[rows]
                for i, name in enumerate(names):
                    keys, counts = np.unique(hashes[of == i], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([name] * len(keys), pa.string()), "n": pa.array(np.full(len(keys), n, np.int32)),
                        "hash": keys.view(np.int64), "count": pa.array(counts, pa.int64()),
                    })

    counted = (
        sample.select("lang", "text").mapInArrow(count, "lang string, n int, hash long, count long")
        .groupBy("lang", "n", "hash").agg(F.sum("count").alias("count"))
    )
    frequent = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "hash")
    kept = counted.withColumn("nth", F.row_number().over(frequent)).where(
        F.col("nth") <= F.when(F.col("n") == 0, WORDS).otherwise(GRAMS)).drop("nth")
    return build(kept.toArrow())


def build(table: pa.Table) -> Model:
    """The model of counts by ``lang``, ``n`` and ``hash``."""
    languages = sorted(set(table.column("lang").to_pylist()))
    names = {name: i for i, name in enumerate(languages)}
    lang = np.array([names[x] for x in table.column("lang").to_pylist()], np.int64)
    order = table.column("n").to_numpy()
    hashes, counts = table.column("hash").to_numpy().view(np.uint64), table.column("count").to_numpy().astype(float)
    model = Model(languages, [], [])
    for n in range(ORDER + 1):
        keys, at = np.unique(hashes[order == n], return_inverse=True)
        scores = np.zeros((len(keys), len(languages)), np.float32)
        for i in range(len(languages)):
            mine = lang[order == n] == i
            total = counts[order == n][mine].sum()
            if total:
                log = np.log(counts[order == n][mine] / total)
                scores[:, i] = log.min() + np.log(PENALTY)
                scores[at[mine], i] = log
            else:
                scores[:, i] = np.log(PENALTY / max(counts.sum(), 1))
        model.hashes.append(keys)
        model.scores.append(scores)
    return model


def predict_languages(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the whole text alone.

    Null texts and texts without a letter get ``und`` and score 0.  A clashing column of
    that name is replaced; every other column, null ids and repeated rows stay as they are.
    """
    docs = docs.drop("lang_pred", "score")
    given = docs if keep_text else docs.drop("text")
    columns, schema = given.columns, given.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found],
                                             names=[*columns, "lang_pred", "score"])

    return docs.mapInArrow(add, widened(schema, lang_pred="string", score="double"))


def label_rows(docs: DataFrame) -> DataFrame:
    """The rows a language may be learned from."""
    return docs.where(~held_out(F.col("doc_id")))


def keep_known(docs: DataFrame, model: Model, floor: float) -> DataFrame:
    """The rows whose language is known with at least ``floor``; columns as they were."""
    columns = docs.columns
    clash = [c for c in ("lang_pred", "score") if c in columns]
    given = docs.withColumnsRenamed({c: f"_given_{c}" for c in clash})
    found = predict_languages(given, model, keep_text=True)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= floor)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"_given_{c}": c for c in clash}).select(*columns)
