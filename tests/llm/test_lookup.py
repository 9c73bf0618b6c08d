"""Spelling variants, ranked search and largest products against brute force, and their edge cases."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import lexical, maxscore, queries, spelling
from memloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"
LONG = "over the long roadway " * 15_000 + "e" * 30_000


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(rows):
    counts = brute_words(rows)
    holes = defaultdict(set)
    for w in counts:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for met in holes.values():
        for a in met:
            near[a] |= {b for b in met if is_near(a, b)}
    forms = {}
    for w, n in counts.items():
        if near[w]:
            first = min(near[w], key=lambda x: (-counts[x], x))
            if counts[first] >= 5 * n:
                forms[w] = first
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return out


@pytest.mark.parametrize("chunk", [spelling.CHUNK, 20])
def test_variants_of_documents(spark, chunk, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    sf_dir = SMALL if chunk == 20 else "/root/testdata/sf0.01"
    rows = [tuple(r) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    found = {tuple(r) for r in queries.op11_spelling(spark, sf_dir).collect()}
    wanted = brute_variants(rows)
    assert found == wanted and any(r[1] for r in wanted)


def test_variants_of_made_words(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abqré"), rng.integers(6, 9))) for _ in range(600)}
    rows = [(None, " ".join([w] * int(rng.integers(3, 200)))) for w in sorted(words)]
    chain = [(None, " ".join([w] * n)) for w, n in (("zzzzzz", 5), ("zzzzzzy", 30), ("zzzzzzyx", 200), ("zzzzzwyx", 1000))]
    found = {tuple(r) for r in spelling.variant_groups(spark.createDataFrame(rows + chain, "doc_id long, text string")).collect()}
    assert found == brute_variants(rows + chain)
    assert ("zzzzzz", "zzzzzzy", "zzzzzwyx", 5, 1, 30) in found


def test_one_edit_of_long_words():
    pairs = [("a" * 5000, "a" * 5001), ("a" * 5000, "a" * 2500 + "b" + "a" * 2499), ("abcdef", "abcdef"), ("abcdef", "abdcef"),
             ("abcdef", "bcdef"), ("abcdef", "abcdefgh"), ("éabcde", "eabcde"), ("aabbcc", "abbccc")]
    a, b = (pa.array([p[i] for p in pairs]) for i in (0, 1))
    la, ca = spelling._flat(a)
    lb, cb = spelling._flat(b)
    found = spelling.one_edit(la, ca[:-1], ca[1:], lb, cb[:-1], cb[1:])
    assert found.tolist() == [i for i, p in enumerate(pairs) if is_near(*p)]


SCHEMA = "doc_id long, text string, m long, n long, word string, rank string, score string, node long, docs string"


def odd_rows():
    texts = [None, "", " \n\t", "-- !?", LONG, "Grosse strassen", "same text here as there", "same text here as there",
             "grösse STRASSEN \u0000 ﬀ😀x"] + ["straßen straßem strassen variant variants"] * 6
    out = [(i, t, 1, 1, "x", "x", "x", 1, "x") for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, "no id at all variant") + (None,) * 7, (None,) * 9]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def test_variants_edges(spark, docs):
    assert {tuple(r) for r in spelling.variant_groups(docs).collect()} == brute_variants([r[:2] for r in odd_rows()])
    assert spelling.variant_groups(docs.limit(0)).count() == 0
    five = spark.createDataFrame([(i, LONG) for i in range(8)] + [(9, "e" * 29_999)] * 5, "doc_id long, text string")
    found = {r["word"]: r["n_near"] for r in spelling.variant_groups(five).collect()}
    assert {len(w) for w in found} >= {7, 30_000} and found["e" * 30_000] == 1


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(docs, items, k=20):
    import math

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + (25 * sum(b.values()) * total) // length
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t, n in Counter(terms(text)).items() if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_ranking_of_documents(spark):
    docs = [tuple(r) for r in documents(spark, SMALL).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    found = sorted((tuple(r) for r in queries.op12_ranked_search(spark, SMALL).collect()), key=repr)
    assert found == brute_ranking(docs, items)


@pytest.mark.parametrize("cells", [lexical.CELLS, 4])
def test_ranking_edges(spark, docs, cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    many = [(100 + i, f"tie word{i % 3} STRASSEN", 1, 1, "x", "x", "x", 1, "x") for i in range(60)]
    docs = docs.union(spark.createDataFrame(many, SCHEMA))
    items = [(1, "strassen Strassen tie"), (1, "same text"), (2, None), (3, ""), (4, "unknownword"), (None, "no id"), (5, LONG), (6, "the ﬀ😀x")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build_index(docs)
    rows = [r[:2] for r in odd_rows()] + [r[:2] for r in many]
    for k in (2, 20):
        found = sorted((tuple(r) for r in lexical.search(index, frame, k).collect()), key=repr)
        assert found == brute_ranking(rows, items, k)
    assert lexical.search(index, frame.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(docs.limit(0)), frame).count() == 0


def test_index_is_reused_by_tables(spark, docs):
    strata = lexical.build_index(docs).strata.toPandas()
    assert (strata["term_runs"].map(sum) == strata["tfs"].map(len)).all()
    assert (strata["run_docs"].map(sum) == strata["slots"].map(len)).all()


def brute_products(rows, k=5):
    fine = [(n, i, np.floor(256 * np.array(e, np.float64))) for n, (i, e) in enumerate(rows)
            if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, i, q in fine:
        if i is None or i % 50:
            continue
        scored = sorted(((-int(q @ e), j is None, j or 0, j) for m, j, e in fine if m != n and len(e) == len(q)), key=lambda x: x[:3])
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def test_products_of_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = sorted((tuple(r) for r in queries.op13_top_products(spark, SMALL).collect()), key=repr)
    assert found == brute_products(rows)


@pytest.mark.parametrize("shard", [maxscore.SHARD, 7])
def test_products_edges(spark, shard, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(0, 0.5, 6)] for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(0, vectors[0]), (50, vectors[50]), (50, vectors[50]), (None, vectors[100]), (None, None), (200, None), (250, []), (300, []),
             (350, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5),
             (500, [-1.0] * 6), (550, [0.0] * 6), (600, [1.0, 2.0]), (601, [-1.0, -2.0]), (602, [1e-9, 0.5])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, row_no string, score string")
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    held = maxscore.quantised(frame)
    found = sorted((tuple(r) for r in maxscore.top_products(held, held.where("vec_id % 50 = 0")).collect()), key=repr)
    assert found == brute_products(kept)
    none = maxscore.quantised(frame.limit(0))
    assert maxscore.top_products(none, none.where("vec_id % 50 = 0")).count() == 0


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_top_products"])
def test_sql_of_lookups(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SMALL)
    wanted = con.execute(queries.ORACLE[name])
    assert [d[0] for d in wanted.description] == found.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)
