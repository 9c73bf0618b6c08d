"""A written snapshot brought forward in place: only touched directories change."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from memloom.operators import snapshot as snap
from memloom.operators.delta import apply_deltas
from memloom.plans import purge, rebuild, views as v
from memloom.schemas import MANIFEST_DDL, struct_of, struct_type
from memloom.sources import sinks

BUCKETS = 3


def records(spark, rows):
    """(position, agent, id, content, day or None, has an embedding)"""
    df = spark.createDataFrame(rows, "pos long, agent_id string, id string, content string, day timestamp, e boolean")
    typ = struct_of(v._TEMPORAL, created_at=F.col("day"))
    whole = v.whole_records(df.select(v.place(F.col("pos")), "agent_id", "id", "content", typ.alias("temporal")))
    kind = whole.schema["embeddings"].dataType.simpleString()
    one = f"from_json(to_json(named_struct('e', array(named_struct('dimensions', 2)))), 'e {kind}').e"
    flags = df.select(v.place(F.col("pos")), F.col("agent_id").alias("a"), F.col("id").alias("i"), "e")
    whole = whole.join(flags.drop("ord"), (whole["agent_id"] == F.col("a")) & (whole["id"] == F.col("i")))
    return whole.withColumn("embeddings", F.when(F.col("e"), F.expr(one))).drop("a", "i", "e")


def day(quarter):
    year, q = quarter.split("-Q")
    return dt.datetime(int(year), int(q) * 3 - 1, 10)


def base_rows():
    rows = []
    for a in range(6):
        for n, quarter in enumerate(("2024-Q1", "2024-Q2", "2024-Q3", "2024-Q4")):
            rows.append((n, f"a{a}", f"r{n}", "old", day(quarter), a == 1 and n == 0))
    return [*rows, (9, "a0", "undated", "old", None, False)]


@pytest.fixture
def written(spark, tmp_path):
    recs = records(spark, base_rows())
    agents = recs.select("agent_id").distinct()
    agent_t = struct_type(MANIFEST_DDL)["agent"].dataType.simpleString()
    layers = snap.layer_inventory(agents, memory=snap.memory_inventory(recs.where("temporal.created_at IS NOT NULL"), v.ts(v.AS_OF)))
    named = agents.withColumn("agent", struct_of(agent_t, id=F.col("agent_id")))
    path = str(tmp_path / "snap")
    sinks.write_snapshot(sinks.Snapshot(recs, snap.build_manifest(named, layers, v.ts(v.AS_OF))), path, buckets=BUCKETS)
    return path


def deltas(spark, rows):
    found = records(spark, [(i, *r[1:]) for i, r in enumerate(rows)])
    ops = spark.createDataFrame([(r[1], r[2], r[0], i) for i, r in enumerate(rows)], "a string, i string, operation string, n long")
    return found.join(ops, (F.col("agent_id") == F.col("a")) & (F.col("id") == F.col("i"))).withColumn("delta_seq", F.lit(1)).withColumnRenamed(
        "n", "pos").drop("a", "i")


CHANGES = [("update", "a0", "r1", "new", day("2024-Q2"), False), ("update", "a1", "r0", "moved", day("2025-Q1"), False),
           ("delete", "a2", "r3", "", day("2024-Q4"), False), ("create", "a3", "r8", "made", day("2023-Q4"), True),
           ("merge", "a4", "r0", "skipped", day("2024-Q1"), False)]


def files(path):
    out = {}
    for folder, _, names in os.walk(f"{path}/records"):
        for name in names:
            if name.endswith(".parquet"):
                out[os.path.join(folder, name)] = os.stat(os.path.join(folder, name)).st_mtime_ns
    return out


def state(snapshot):
    return sorted((r["agent_id"], r["id"], r["content"], str(r["temporal"]["created_at"])) for r in snapshot.collect())


def test_only_touched_directories_change(spark, written):
    given = deltas(spark, CHANGES)
    before, old = files(written), sinks.read_snapshot_tables(spark, written)
    wanted = state(apply_deltas(old.records, given))
    parts = rebuild.touched_parts(spark.read.parquet(f"{written}/records"), given, BUCKETS)
    new = rebuild.update_snapshot(spark, written, given, None, v.ts("2024-12-31 00:00:00"), buckets=BUCKETS)
    assert state(new.records) == wanted
    after = files(written)
    for path, at in before.items():
        quarter, bucket = path.split("/records/quarter=")[1].split("/bucket=")
        if f"{quarter}/{bucket.split('/')[0]}" not in parts:
            assert after.get(path) == at, path
    assert {f"{q}/" for q in ("2024-Q2", "2024-Q1", "2024-Q4", "2025-Q1", "2023-Q4")} == {p.split("/")[0] + "/" for p in parts}
    assert not os.path.exists(f"{written}/touched")
    inventory = {r["agent_id"]: r["layers"]["memory"] for r in new.manifests.collect()}
    whole = snap.memory_inventory(new.records.where("temporal.created_at IS NOT NULL"), v.ts("2024-12-31 00:00:00"))
    assert {r["agent_id"]: r["memory"] for r in whole.collect()} == inventory
    assert not inventory["a1"]["has_embeddings"] and inventory["a3"]["has_embeddings"]


def test_a_job_that_died_goes_on(spark, written, monkeypatch):
    given = deltas(spark, CHANGES)
    wanted = state(apply_deltas(sinks.read_snapshot_tables(spark, written).records, given))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "replace_parts", dies)
        with pytest.raises(RuntimeError):
            rebuild.update_snapshot(spark, written, given, None, v.ts(v.AS_OF), buckets=BUCKETS)
    with pytest.raises(ValueError):  # half a snapshot is none
        sinks.read_snapshot_tables(spark, written)
    new = rebuild.update_snapshot(spark, written, given, None, v.ts(v.AS_OF), buckets=BUCKETS)
    assert state(new.records) == wanted


def test_directories_without_a_record_go(spark, written):
    every = [("delete", r[1], r[2], "", r[4], False) for r in base_rows() if r[2] == "r0"]
    new = rebuild.update_snapshot(spark, written, deltas(spark, every), None, v.ts(v.AS_OF), buckets=BUCKETS)
    assert not os.path.exists(f"{written}/records/quarter=2024-Q1") or not any(
        "2024-Q1" in f for f in files(written))
    assert new.records.count() == len(base_rows()) - 6
    assert sum(r["layers"]["memory"]["record_count"] for r in new.manifests.collect()) == len(base_rows()) - 7
    none = rebuild.update_snapshot(spark, written, deltas(spark, every[:1]).where("false"), None, v.ts(v.AS_OF), buckets=BUCKETS)
    assert none.records.count() == len(base_rows()) - 6


def test_purge_of_few_and_unknown_ids(spark, written):
    wanted = spark.createDataFrame([("a0", "r2", "asked"), ("a0", "undated", "asked"), ("a5", "none", "odd"), ("a0", "r2", "again")],
                                   "agent_id string, id string, reason string")
    found = purge.find_records(spark, written, wanted, BUCKETS)
    assert {(r["agent_id"], r["id"], r["part"].split("/")[0]) for r in found.collect()} == {("a0", "r2", "2024-Q3"), ("a0", "undated", "")}
    assert all(os.path.exists("/" + r["file"].removeprefix("file:").lstrip("/")) for r in found.collect())
    before = files(written)
    rows = purge.purge_records(spark, written, wanted, v.ts(v.AS_OF), "r1", BUCKETS)
    log = {(r["agent_id"], r["id"], r["reason"], r["copies"]) for r in rows.collect()}
    assert log == {("a0", "r2", "again", 1), ("a0", "undated", "asked", 1), ("a5", "none", "odd", 0)}
    assert len(set(before) - set(files(written))) == 2  # one file of each touched directory
    new = sinks.read_snapshot_tables(spark, written)
    assert new.records.count() == len(base_rows()) - 2 and new.records.where("agent_id = 'a0' AND id = 'r2'").count() == 0
    purge.purge_records(spark, written, wanted, v.ts(v.AS_OF), "r1", BUCKETS)  # the same run again
    assert {r["copies"] for r in purge.purge_log(spark, written).collect()} == {0, 1}


def test_scan_is_told_the_ids(spark, written):
    keys = spark.createDataFrame([("a0", "r2")], "agent_id string, id string")
    plan = purge.find_records(spark, written, keys, BUCKETS)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "r2" in plan.split("PushedFilters:")[1][:200]
    assert "content" not in plan.split("ReadSchema:")[1][:200]
