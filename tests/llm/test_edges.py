"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memloom.llm import decontam, language, licenses, packing, perplexity, quality, queries, sharding, simhash, similar, tokens, toxicity
from memloom.session import shared_dir

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score string, "
          "digest string, label string, shard string, words string, half string, _row string, given string, "
          "copy string, row_no string, root string, key string, more string, n string")
LONG = "over the long road " * 15_000 + "e" * 30_000


def rows():
    texts = [None, "", " \n\t", "42 -- 17!", "the cat sat on the mat and the dog lay by the door", LONG,
             "same text here as there", "same text here as there", "der Hund liegt vor der Tür und schläft im Haus", "𝒳 😀 \u0000 ﬀ"]
    out = [(i, t, ["en", None, "de"][i % 3], ["a", None][i % 2], [len(t or ""), None][i % 2]) + ("x",) * 15
           for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, "no id at all", "en", "a", 3) + (None,) * 15, (None,) * 20]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (6, 1, None), (7, None, 0), (8, 1, 0), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "The cat sat on the mat, and the dog"), (2, None), (3, "dog lay"), (None, "x"), (4, "--")],
                                 "item_id long, text string")


def cache(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


OPERATORS = {
    "quality": lambda d, labels, items: quality.score_quality(d, labels),
    "language": lambda d, labels, items: language.predict_languages(
        d, language.learn(language.label_rows(d))).select("doc_id", "lang_pred", "score"),
    "simhash": lambda d, labels, items: simhash.near_components(d),
    "tokens": lambda d, labels, items: tokens.token_counts(
        d, public_tokenizers.path("piece_bpe_32k.model"), cache(d.sparkSession, "cache")),
    "shards": lambda d, labels, items: sharding.shard_by_bytes(d, 3),
    "licenses": lambda d, labels, items: licenses.scan_licenses(d),
    "toxicity": lambda d, labels, items: toxicity.score_toxicity(d, toxicity.learn(d, labels)),
    "rules": lambda d, labels, items: perplexity.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, empty, labels, items, name):
    found = OPERATORS[name](docs, labels, items).toPandas()
    assert len(found) == docs.count()
    assert found["doc_id"].isna().sum() == 2
    for column in ("score", "kept", "n_tokens", "shard", "fingerprint", "lang_pred"):
        if column in found:
            assert found[column].notna().all(), column
    assert OPERATORS[name](empty, labels, items).count() == 0


def test_no_labels_at_all(docs, labels):
    none = labels.limit(0)
    assert {r[0] for r in quality.score_quality(docs, none).select("score").distinct().collect()} == {0.5}
    assert toxicity.score_toxicity(docs, toxicity.learn(docs, none)).count() == docs.count()
    model = language.learn(docs.where("false"))
    assert {r[0] for r in language.predict_languages(docs, model).select("lang_pred").collect()} == {"und"}


def test_filters_keep_rows_as_they_are(docs, empty, labels, items):
    model = language.learn(language.label_rows(docs))
    steps = {
        "language": lambda d: language.keep_known(d, model, 0.0),
        "quality": lambda d: quality.keep_good(d, labels, 0.0),
        "copies": similar.drop_similar,
        "leaks": lambda d: decontam.drop_leaks(d, items),
    }
    given = {tuple(r) for r in docs.collect()}
    for name, step in steps.items():
        kept = step(docs)
        assert kept.columns == docs.columns, name
        assert {tuple(r) for r in kept.collect()} <= given, name
        assert step(empty).count() == 0, name
    assert quality.keep_good(docs, labels, 0.0).count() == docs.count()
    assert sorted(r[0] for r in language.keep_known(docs, model, 0.0).where("doc_id < 4").select("doc_id").collect()) == []
    left = [r[0] for r in similar.drop_similar(docs).select("doc_id").collect()]
    assert left.count(6) == 1 and 7 not in left and 4 in left


def test_items_of_every_length_are_found(docs, empty, items):
    found = {tuple(r)[:4] for r in decontam.find_items(docs, items).collect()}
    assert found == {(4, 1, 5, 5), (4, 3, 1, 1)}
    assert decontam.find_items(empty, items).count() == 0
    assert decontam.find_items(docs, items.limit(0)).count() == 0


def test_packing_edges(docs, empty):
    packed = packing.pack(docs, queries.byte_vocabulary(), 2048, 1)
    pieces = packed.pieces.toPandas()
    assert pieces.groupby("doc_id", dropna=False)["length"].sum().loc[0] == 1  # null text: the end id alone
    assert packed.plan.count() == len(pieces)
    assert packing.pack(empty, queries.byte_vocabulary()).plan.count() == 0


def test_names_of_results(docs, labels):
    assert "passages" in toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).columns
    assert licenses.scan_licenses(docs).where(F.size("detections") > 0).count() == 0
