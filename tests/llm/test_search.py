"""Near copies and benchmark items against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memloom.llm import components, decontam, queries, simhash
from memloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_of(labels):
    out = defaultdict(set)
    for i, label in enumerate(labels):
        out[label].add(i)
    return {frozenset(g) for g in out.values()}


def brute_components(codes, distance):
    label = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= distance
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("flips", [2, 4, 7])
def test_index_connects_what_brute_force_connects(flips):
    rng = np.random.default_rng(flips)
    codes = np.full(400, rng.integers(0, 2**63), np.uint64)
    for _ in range(flips):
        codes ^= np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64)
    codes = rng.permutation(np.unique(np.r_[codes, rng.integers(0, 2**63, 400, dtype=np.uint64)]))
    found = simhash.link_groups(np.zeros(len(codes), np.int64), codes, 4)
    assert groups_of(found) == groups_of(brute_components(codes, 4))


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 8])
def test_components_of_documents(spark, chunk):
    rows = documents(spark, SMALL).select("doc_id", "text").collect()
    codes = np.array([brute_fingerprint(r["text"]) for r in rows], np.uint64)
    label = brute_components(codes, 4)
    least = {g: min(rows[i]["doc_id"] for i in range(len(rows)) if label[i] == g) for g in set(label.tolist())}
    expected = {r["doc_id"]: (f"{c:016x}", least[g]) for r, c, g in zip(rows, codes, label.tolist())}
    if chunk == simhash.CHUNK:
        found = {r[0]: (r[1], r[2]) for r in queries.op3_simhash(spark, SMALL).collect()}
        assert found == expected
    else:
        table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fingerprint long")
        roots = {r[0]: r[1] for r in components.components(simhash.near_edges(table, 4, chunk)).collect()}
        got = [roots.get(int(c), int(c)) for c in codes.view(np.int64)]
        assert groups_of(got) == groups_of(label.tolist())


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    edges = edges.union(spark.createDataFrame([(100, 101), (101, 100), (5, 5)], "u long, v long"))
    found = {r[0]: r[1] for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_items_against_brute_force(spark):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def shingles(w, k):
        return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)}

    docs = documents(spark, SMALL).select("doc_id", "text").collect()
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    # an item of which a document holds 80 percent only, far apart, and one it holds 79 percent of
    base = words(docs[0]["text"])[:104]
    items += [(900, base[:84] + [f"new{i}" for i in range(20)]), (901, base[:83] + [f"new{i}" for i in range(21)]),
              (902, base[:60] + ["gap"] + base[60:104])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    expected = set()
    for d in docs:
        held = shingles(words(d["text"]), 5)
        for i, w in items:
            own = shingles(w, min(5, len(w)))
            shared = len(own & (held if len(w) >= 5 else shingles(words(d["text"]), len(w))))
            if own and shared >= 0.8 * len(own):
                expected.add((d["doc_id"], i, len(own), shared))
    found = {tuple(r)[:4] for r in decontam.find_items(documents(spark, SMALL), table).collect()}
    assert found == expected and any(i == 900 for _, i, _, _ in found)
    kept = {r[0] for r in decontam.drop_leaks(documents(spark, SMALL), table).select("doc_id").collect()}
    assert kept == {d["doc_id"] for d in docs} - {d for d, *_ in expected}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = {tuple(r) for r in decontam.find_items(documents(spark, SMALL), items).collect()}
    real = decontam.item_blocks
    monkeypatch.setattr(decontam, "item_blocks", lambda rows: real(rows, 60))
    assert {tuple(r) for r in decontam.find_items(documents(spark, SMALL), items).collect()} == whole


def test_items_of_few_shingles_are_never_missed():
    rng = np.random.default_rng(1)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in [5] * 4000 + [6] * 500 + [7] * 500 + [8] * 500 + [9] * 300 + [2] * 300]
    block = decontam.Items.of(list(range(len(items))), items)
    filler = " ".join(f"x{x}" for x in rng.integers(0, 10**6, 40))
    texts = [f"{filler} {items[i]} {filler} {items[(i * 7 + 1) % len(items)]} z" for i in range(len(items))]
    found = {(r, i) for r, i, _ in block.search(decontam.pa.array(texts), 0.8)}
    wanted = {(i, i) for i in range(len(items))} | {(i, (i * 7 + 1) % len(items)) for i in range(len(items))}
    assert wanted <= found and len(found) < len(wanted) + 50


def test_items_that_share_their_shingles():
    block = decontam.Items.of([0, 1, 2, 3], ["a b c d e", "a b c d e", "A, b c d e f", "c d"])
    found = sorted(block.search(decontam.pa.array(["x a b c d e f", "a b c d e", "a b c d", None]), 0.8))
    assert found == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 1), (1, 0, 1), (1, 1, 1), (1, 3, 1), (2, 3, 1)]
