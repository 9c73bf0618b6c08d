"""Token counts, shards, licences, packing and the pipeline."""

import re
import time
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import decontam, licenses, packing, queries, sharding, tokens
from memloom.llm.common import documents
from memloom.session import shared_dir

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, name):
    cache = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    model = public_tokenizers.path(name)
    docs = documents(spark, SMALL)
    found = {r[0]: (r[1], r[2]) for r in tokens.token_counts(docs, model, cache).collect()}
    for row in docs.collect():
        text = row["text"] or ""
        assert found[row["doc_id"]] == (len(text.encode()), tokens.count_tokens(model, [text])[0])
    stored = spark.read.parquet(cache).count()
    assert stored == docs.select("text").distinct().count()
    again = {r[0]: (r[1], r[2]) for r in tokens.token_counts(docs, model, cache).collect()}
    assert again == found and spark.read.parquet(cache).count() == stored  # nothing was encoded again


def test_shards(spark):
    found = queries.op6_byte_shards(spark, MEDIUM).toPandas()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, MEDIUM).collect()}
    assert set(found["doc_id"]) == set(texts) and len(found) == len(texts)
    assert all(s == len(texts[d]) + 8 and c == zlib.crc32(texts[d])
               for d, s, c in zip(found["doc_id"], found["size"], found["text_crc32"]))
    by = found.groupby("shard")
    assert set(by.groups) == set(range(24))
    assert all(sorted(g) == list(range(len(g))) for _, g in by["slot"])
    sizes = by["size"].sum()
    assert (abs(sizes - found["size"].sum() / 24) <= found["size"].max()).all()
    # copies stand together: a text is in one shard, or in neighbours
    spread = found.groupby("text_crc32")["shard"].agg(["min", "max"])
    assert (spread["max"] - spread["min"]).max() <= 1


def test_more_shards_than_documents(spark):
    found = sharding.shard_by_bytes(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), 5).collect()
    assert len(found) == 2 and all(0 <= r["shard"] < 5 and r["slot"] == 0 for r in found)


def brute_licenses(text, table):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words))
                  if words[i: i + len(phrase.split())] == phrase.split())
    joined = " " + " ".join(words) + " "
    found = [(joined[: m.start()].count(" ") - 1, joined[: m.end()].count(" ") - 1, n)
             for n, r in enumerate(table) for m in re.finditer(r.pattern, joined)]
    kept = [d for d in found if not any(
        e[0] <= d[0] and e[1] >= d[1] and (e[1] - e[0] > d[1] - d[0] or e[2] < d[2]) for e in found)]
    names = {label for _, label in base}
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted(names)), ",".join(sorted(names | {table[n].label for *_, n in kept})))


CASES = [
    "This is licensed under the GNU General Public License, version 3 or so; see www.gnu.org/licenses/gpl-3.0",
    "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0",
    "CC BY-NC-SA 4.0 International, or CC BY; the MIT License. MIT License!", "mit", "ＭＩＴ license gnu", "KGNU General",
    "Creative Commons Attribution-ShareAlike 3.0 Unported; all rights reserved", "do what the fox you want to public license",
    "available under the terms of the BSD 3-Clause License", "", None, "gnu general public license gnu general public license",
]


def test_suppression_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    lists = [[(int(a), int(a + w), int(n), f"l{n}", 0.5) for n, (a, w) in enumerate(zip(
        rng.integers(0, reach, size), rng.integers(0, 9, size)))] for size, reach in
        [(0, 1), (1, 1), (64, 20), (65, 900), (300, 400), (1000, 4000), (2000, 100)]]
    kind = "array<struct<first:int,last:int,nth:int,label:string,confidence:double>>"
    rows = spark.createDataFrame(list(enumerate(lists)), f"n int, found {kind}")
    got = {r["n"]: [tuple(d) for d in r["left"]] for r in rows.select("n", licenses.suppress(F.col("found")).alias("left")).collect()}
    for n, found in enumerate(lists):
        want = [d for d in found if not any(
            e[0] <= d[0] and e[1] >= d[1] and (e[1] - e[0] > d[1] - d[0] or e[2] < d[2]) for e in found)]
        assert got[n] == sorted(want), n


def test_thousands_of_grants_in_one_text(spark):
    grant = "licensed under the Apache License, Version 2.0. "
    docs = spark.createDataFrame([(1, grant * 6000)], "doc_id long, text string")
    found = licenses.scan_licenses(docs).select("n_base", F.size("detections").alias("n"))
    start = time.perf_counter()
    assert [tuple(r) for r in found.collect()] == [(6000, 6000)]
    assert time.perf_counter() - start < 30


def test_licenses_against_brute_force(spark):
    table = licenses.rules()
    assert len(table) > 300 and len({r.pattern for r in table}) > 300
    texts = CASES + [r["text"] for r in documents(spark, MEDIUM).where("text rlike '(?i)licen[sc]e|cc by|rights'").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    found = {r["doc_id"]: tuple(r[f] for f in fields) for r in licenses.scan_licenses(docs, table).collect()}
    for i, text in enumerate(texts):
        assert found[i] == brute_licenses(text, table), text


def test_licenses_stay_in_the_jvm(spark):
    plan = licenses.scan_licenses(documents(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_no_window_is_over_capacity(lengths):
    lengths = np.array(lengths)
    at = packing.windows_of(lengths, 64)
    loads = np.bincount(at, lengths)
    assert loads.max() <= 64 and len(at) == len(lengths)


def test_differencing_by_hand():
    at = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(at, [8, 7, 6, 5, 4])) == [14, 16]  # the known outcome of differencing
    at = packing.difference(np.array([5, 5, 5, 5]), 4)
    assert sorted(at) == [0, 1, 2, 3]


def packed_exactly(docs, found, window, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary.file)
    for row in docs:
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = found[found["doc_id"] == row["doc_id"]].sort_values("start")
        assert (own["doc_tokens"] == len(ids)).all() and own["length"].sum() == len(ids)
        for start, length, crc in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(ids[start: start + length].tobytes()) == crc
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        ends = own["offset"] + own["length"]
        assert own["offset"].iloc[0] == 0 and ends.iloc[-1] <= window
        assert (own["offset"].iloc[1:].values == ends.iloc[:-1].values).all()


def test_packing_keeps_every_id(spark):
    found = queries.op9_packing(spark, SMALL).toPandas()
    packed_exactly(documents(spark, SMALL).collect(), found, 2048, queries.byte_vocabulary())
    assert found["length"].sum() / (2048 * found["sequence_id"].nunique()) > 0.97


def test_both_libraries_agree():
    vocabulary = queries.byte_vocabulary()
    texts = ["Plain text, 12 of it's  words\n\n\tend ", "a<|endoftext|>b", "naïve Ångström œuvre", "東京 　x\u0085y", "x​ z", ""]
    slow = packing.Vocabulary(vocabulary.file)
    assert vocabulary.encode(texts) == slow.encode(texts)


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(documents(spark, SMALL), queries.byte_vocabulary(), 512, 1, piece_tokens=128, group_windows=16)
    rows = packed.sequences(512).collect()
    total = packed.pieces.agg({"length": "sum"}).first()[0]
    assert all(len(r["ids"]) == 512 for r in rows) and len(rows) * 512 >= total
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_pipeline_against_plain_steps(spark):
    from test_similar import brute_kept

    from memloom.llm import language, quality
    docs = {r["doc_id"]: r["text"] for r in documents(spark, SMALL).collect()}
    known = language.predict_languages(documents(spark, SMALL), language.learn(language.label_rows(documents(spark, SMALL))))
    ids = [r[0] for r in known.where("lang_pred <> 'und'").where(known["score"] >= queries.LANGUAGE_FLOOR).select("doc_id").collect()]
    left = documents(spark, SMALL).where(f"doc_id IN ({','.join(map(str, ids))})")
    good = quality.score_quality(left, spark.read.parquet(f"{SMALL}/labels.parquet"))
    ids = sorted(r[0] for r in good.where(good["score"] >= queries.QUALITY_FLOOR).select("doc_id").collect())
    ids = sorted(brute_kept([(i, docs[i]) for i in ids]))

    def shingles(text, k=5):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i: i + k]) for i in range(len(words) - k + 1)}

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    ids = [i for i in ids if not any(len(s & shingles(docs[i])) >= 0.8 * len(s) for s in items if s)]
    found = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(found["doc_id"]) == set(ids) and len(ids) < len(docs)
    packed_exactly([{"doc_id": i, "text": docs[i]} for i in ids], found, 2048, queries.byte_vocabulary())


def test_pipeline_stages_take_effect(spark):
    docs = documents(spark, MEDIUM)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, MEDIUM)
        assert kept.columns == docs.columns
        before = {r[0] for r in docs.select("doc_id").collect()}
        ids = [r[0] for r in kept.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        seen[name] = len(before) - len(ids)
        docs = documents(spark, MEDIUM).join(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id")
    assert seen["quality"] > 50 and seen["near-copies"] > 20 and seen["decontamination"] > 5
    items = spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    assert decontam.find_items(docs, items).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_many_tiny_texts_are_divided_as_few_parts(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise("word").alias("text"))
    packed = packing.pack(docs.coalesce(2), queries.byte_vocabulary(), 2048, 1)
    parts = packed.pieces.groupBy("bundle").agg(F.sum("length").alias("n"))
    assert parts.count() < 2 * packed.pieces.agg(F.sum("length")).first()[0] / packing.SMALL_TOKENS
    assert parts.where(F.col("n") > 2 * packing.SMALL_TOKENS).count() == 0
    rows = packed.pieces.join(packed.plan, "piece").toPandas()
    assert len(rows) == 30_000 and rows["length"].sum() == 50_000
    sizes = rows.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 2048 and len(sizes) <= 27


def test_bundles():
    assert packing.bundles(np.array([1, 1, 200, 3, 63, 63, 63, 64, 5]), 64).tolist() == [0, 1, 0, 0, 1, 0, 1, 0, 0]
