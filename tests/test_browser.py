"""Postings by facet and artifact tiers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from memloom.operators import artifacts, browse
from memloom.plans import views as v
from memloom.schemas import RECORD_FIELDS, struct_of

BUCKETS = 3


def records(spark, rows):
    """(agent, id, type, status, tags, entities, day)"""
    df = spark.createDataFrame(rows, "agent_id string, id string, memory_type string, status string, tags array<string>, names array<string>, day timestamp")
    kind = RECORD_FIELDS["entities"]
    entities = F.from_json(F.to_json(F.struct(F.transform("names", lambda n: F.struct(n.alias("name"))).alias("e"))), f"e {kind}")["e"]
    return v.whole_records(df.select(v.place(F.lit(0)), "agent_id", "id", "memory_type", "status", "tags", entities.alias("entities"),
                                     struct_of(RECORD_FIELDS["temporal"], created_at=F.col("day")).alias("temporal")))


D = [dt.datetime(2026, 1, n) for n in range(1, 9)]
ROWS = [("a", "1", "episodic", "active", ["x", "x", "y"], ["Ann"], D[0]), ("a", "2", "semantic", "active", None, None, D[1]),
        ("b", "3", "semantic", "stale", ["x"], ["Bob", "Ann"], D[2]), ("c", "4", "semantic", "active", [], [], None),
        ("d", "5", None, None, ["y", None], None, D[4])]


@pytest.fixture
def index(spark, tmp_path):
    path = str(tmp_path / "facets")
    browse.write_index(records(spark, ROWS), path, BUCKETS)
    return path


def found(spark, index, *args, **facets):
    return {r["id"] for r in browse.browse(spark, index, *args, buckets=BUCKETS, **facets).collect()}


def test_facets_meet(spark, index):
    assert found(spark, index) == {"1", "2", "3", "4", "5"}
    assert found(spark, index, tag="x") == {"1", "3"} and found(spark, index, tag=["x", "y"]) == {"1", "3", "5"}
    assert found(spark, index, entity="Ann", status="stale") == {"3"}
    assert found(spark, index, ["a", "b"], type="semantic") == {"2", "3"}
    assert found(spark, index, days=("2026-01-02", "2026-01-05")) == {"2", "3"} and found(spark, index, tag="none") == set()
    with pytest.raises(ValueError):
        browse.browse(spark, index, colour="red")


def test_only_asked_directories_are_read(spark, index):
    found = browse.browse(spark, index, ["a"], buckets=BUCKETS, tag="x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("PartitionFilters:")[1].split("]")[0]
    assert "facet" in scan and "bucket" in scan and "EqualTo(value,x)" in plan.replace("In(value, [x])", "EqualTo(value,x)")


def test_deltas_bring_the_index_forward(spark, index):
    changes = records(spark, [("a", "1", "episodic", "archived", ["z"], None, D[0]), ("b", "3", None, None, None, None, None),
                              ("b", "6", "episodic", "active", ["x"], None, D[6])])
    op = F.when(F.col("id") == "1", "update").when(F.col("id") == "3", "delete").otherwise("create")
    deltas = changes.select("*", op.alias("operation"), F.lit(1).alias("delta_seq"), F.lit(0).alias("pos"))
    early = deltas.where("id = '6'").withColumns({"operation": F.lit("delete"), "pos": F.lit(-1)})
    for _ in range(2):  # again changes nothing
        browse.upsert_index(spark, index, deltas.union(early), BUCKETS)
        assert found(spark, index) == {"1", "2", "4", "5", "6"}
        assert found(spark, index, tag="x") == {"6"} and found(spark, index, tag="z", status="archived") == {"1"}
        assert found(spark, index, status="stale") == set() and found(spark, index, entity="Bob") == set()
    assert not os.path.exists(f"{index}-next")
    counts = {(r["facet"], r["value"]): r["n"] for r in browse.facet_counts(browse.read_index(spark, index), "type").collect()}
    assert counts == {("type", "episodic"): 2, ("type", "semantic"): 2}


def test_pages_go_on(spark, index):
    every = browse.browse(spark, index, buckets=BUCKETS)
    first = browse.page(every, 2).collect()
    assert [r["id"] for r in first] == ["5", "3"]
    last = first[-1]
    assert [r["id"] for r in browse.page(every, 9, (last["seen"], last["agent_id"], last["id"])).collect()] == ["2", "1"]


def test_tiers_of_artifacts(spark):
    mb = 1 << 20
    rows = [("a", "MEMORY.md", 50 * mb), ("a", "c.toml", 10), ("a", "big.json", mb), ("a", "x.bin", 4 * mb), ("a", "y.bin", 4 * mb), ("a", "z.bin", 3 * mb),
            ("a", "huge.bin", 11 * mb), ("a", "unknown.bin", None), ("b", "z.bin", 9 * mb), (None, "n.bin", mb)]
    files = spark.createDataFrame(rows, "agent_id string, path string, size_bytes long")
    tiers = {(r["agent_id"], r["path"]): (r["tier"], r["archive_path"]) for r in artifacts.tier_artifacts(files, budget=8 * mb).collect()}
    assert tiers["a", "MEMORY.md"] == (1, "raw/openclaw/MEMORY.md") and tiers["a", "c.toml"][0] == 1
    assert [tiers["a", p][0] for p in ("big.json", "z.bin", "x.bin", "y.bin", "huge.bin", "unknown.bin")] == [2, 2, 2, 3, 3, 3]
    assert tiers["b", "z.bin"] == (3, None) and tiers[None, "n.bin"] == (2, "artifacts/n.bin")
    free = {r["path"]: r["tier"] for r in artifacts.tier_artifacts(files.where("agent_id = 'a'")).collect()}
    assert free["y.bin"] == 2 and artifacts.tier_artifacts(files.limit(0), budget=1).count() == 0


def test_one_agent_over_many_ranges(spark):
    files = spark.range(4000).select(F.lit("hot").alias("agent_id"), F.format_string("f%05d", "id").alias("path"), (F.col("id") % 7 + 1).alias("size_bytes"))
    summed = artifacts.running_total(files.repartition(8), "agent_id", ["size_bytes", "path"], "size_bytes", "total").collect()
    total = 0
    for r in sorted(summed, key=lambda r: (r["size_bytes"], r["path"])):
        total += r["size_bytes"]
        assert r["total"] == total


def test_an_upsert_writes_its_buckets_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facets")
    rows = v.whole_records(v.event_records(spark, "/root/testdata/sf0.001")).limit(50)
    browse.write_index(rows, path, buckets=BUCKETS)
    before = browse.facet_counts(browse.read_index(spark, path), "type").collect()
    written, write = [], browse._write
    monkeypatch.setattr(browse, "_write", lambda *a: (written.append(a[1]), write(*a)))
    deltas = rows.select("*", F.lit("update").alias("operation"), F.lit(1).alias("delta_seq"), F.col("ord.pos").alias("pos"))
    browse.upsert_index(spark, path, deltas, buckets=BUCKETS)
    assert written == [f"{path}-next"] and not os.path.exists(f"{path}-next")
    assert sorted(browse.facet_counts(browse.read_index(spark, path), "type").collect()) == sorted(before)
