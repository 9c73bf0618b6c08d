"""The near-copies stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import pytest

from memloom.llm import similar
from memloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows, similarity=0.8):
    """Smallest id of each group; texts without a word are one group."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            both = len(a & b)
            if not a and not b or both and both / (len(a) + len(b) - both) >= similarity:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if label[i] == i}


def edited():
    """Texts of many lengths and copies with words exchanged, on both sides of 0.8."""
    rng = random.Random(7)
    out = []
    for n in [1, 3, 4, 5, 6, 9, 30, 60, 120, 400]:
        base = [f"w{rng.randrange(10_000)}" for _ in range(n)]
        out.append(base)
        for changes in (0, 1, 1, 2, 3, 4, 6, 8, 9, 10):
            words = list(base)
            for at in rng.sample(range(n), min(n, changes)):
                words[at] = f"x{rng.randrange(10_000)}"
            out.append(words)
    frame = [f"frame{i}" for i in range(60)]  # a group in which each is near some, and one that is just apart
    for i in range(40):
        out.append(frame[: 56 + i % 5] + [f"own{i}", *frame[i % 7: 3 + i % 7]])
        out.append(frame[:50] + [f"other{i}x{j}" for j in range(12)])
    texts = [" ".join(w) for w in out] + ["", None, " \n", "ONE word", "one  Word"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_keeps_what_brute_force_keeps(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r[0] for r in corpus_pipeline.one_of_each(spark, docs, "").select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)


def test_order_of_shingles_changes_nothing(spark, monkeypatch):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "COMMON", 5)
    monkeypatch.setattr(similar, "FEW", 0)
    assert {r[0] for r in similar.drop_similar(docs).select("doc_id").collect()} == brute_kept(rows)


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_keys_that_meet(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.randrange(60), rng.randrange(9), 0, 5) for _ in range(120)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = spark.createDataFrame(rows, "key long, copy long, place int, n int")
        found = sorted((r["key"], r["copy"], r["least"]) for r in similar.meeting(table).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    of = {}
    for key, copy, *_ in rows:
        of.setdefault(key, set()).add(copy)
    assert found == sorted((k, c, min(v)) for k, v in of.items() if len(v) > 1 for c in v)


def test_stage_on_given_documents(spark):
    docs = documents(spark, SF)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {r[0] for r in corpus_pipeline.one_of_each(spark, docs, SF).select("doc_id").collect()}
    assert kept == brute_kept(rows) and len(kept) < len(rows)


def test_texts_of_one_half_digest_stay_apart(spark, monkeypatch):
    class Digest:
        def __init__(self, data, digest_size):
            self.data = data

        def digest(self):
            return b"\0" * 8 + __import__("hashlib").blake2b(self.data, digest_size=8).digest()

    rows = [(1, "one two three"), (2, "four five"), (3, "ONE two  three"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS row_no")
    monkeypatch.setattr(similar, "blake2b", Digest)
    found = {r["doc_id"]: r["copy"] for r in similar.copies(docs).collect()}
    assert found[1] == found[3] and len(set(found.values())) == 3


def test_many_texts_just_apart(spark):
    """One frame with as many own words that no two texts are near, and one copy of each: all are checked, none is lost."""
    frame = [f"frame{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        words = frame[:48] + [f"own{i}x{j}" for j in range(8)] + frame[48:]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "tail"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    kept = {r[0] for r in similar.drop_similar(docs).select("doc_id").collect()}
    assert kept == {2 * i for i in range(1500)}


def test_sketches_never_say_less_than_the_texts(spark):
    rows = [(i, t) for i, t in edited() if (t or "").split()][:120]
    docs = spark.createDataFrame(rows, "copy long, text string")
    bits = {r["copy"]: r["sketch"] for r in similar.sketches(docs).collect()}
    for i, (a, one) in enumerate(rows):
        for b, other in rows[:i]:
            apart = len(shingles(one) ^ shingles(other))
            assert sum((x ^ y).bit_count() for x, y in zip((v % (1 << 64) for v in bits[a]), (v % (1 << 64) for v in bits[b]))) <= apart


def test_a_group_of_near_copies_costs_no_square_of_pairs(spark, monkeypatch):
    """Texts of one frame, most pairs near: what meets one text of the group needs no others."""
    rng = random.Random(11)
    frame = [f"frame{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(frame)
        for at in rng.sample(range(300), rng.choice([2, 3, 3, 4, 4, 4])):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    looked_at, verified = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *more: (looked_at.append(pairs.count()), verified(pairs, *more))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r[0] for r in similar.drop_similar(docs).select("doc_id").collect()} == brute_kept(rows)
    assert sum(looked_at) < 20 * len(rows)
